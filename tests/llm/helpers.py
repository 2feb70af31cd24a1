import random

from pyspark.sql import functions as F

WORDS = "the of and to in is that it for on was with as be by at this have from or said time people year way day man thing woman life child world school state family student group country problem hand part place case week company system program question work government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name president team minute idea kid body information back parent face others level office door health person art war history party result change morning reason research girl guy moment air teacher force education".split()


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def changed(t, share, seed):
    """A near copy: a share of its words, side by side, is replaced."""
    r = random.Random(seed)
    w = t.split()
    k = max(1, int(len(w) * share))
    a = r.randrange(0, len(w) - k + 1)
    w[a : a + k] = [r.choice(WORDS) + "x" for _ in range(k)]
    return " ".join(w)


def docs(spark, rows, extra=False):
    """(doc_id, text, lang, source, n_chars) from (doc_id, text[, lang[, source]]); extra: columns whose names clash with results."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for c in ("kept", "score", "shard", "slot", "ids", "n_tokens", "component_id", "digest", "x", "epoch", "block", "stratum", "matches", "size"):
            df = df.withColumn(c, F.lit("mine"))
    return df
