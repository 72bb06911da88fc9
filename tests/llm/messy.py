"""Small tables with everything that real ones hold: nulls, empty and long texts, ties, repeats, clashing names."""

import random
import zlib

from pyspark.sql import functions as F  # noqa: F401

DOCS = "doc_id long, text string, lang string, key string, score string, scan string"
WORDS = "the of and thing ther ent other small river stone paper light north wind house green".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


def documents(spark):
    base = prose(60, 1)
    near = base.split()
    near[30] = "changed"
    rows = [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, base.upper()), (5, None), (6, ""), (7, "  \n\t "),
        (8, "one two"), (9, "One  TWO"), (10, "one two three"), (11, prose(8000, 2)), (None, prose(40, 3)), (None, prose(40, 3)),
        (None, None), (12, "x" * 50_000), (13, "naïve café \u00a0 日本語 \U0001f600 <|endoftext|> it's 'S"),
        (14, "Licensed under the Apache License, Version 2.0.\nCC-BY, cc by; All Rights Reserved"), (15, base + " tail"),
        (16, prose(30, 4) + "\x1f\x85 \u2003end"), (17, "the general public license"), (18, "cc cc by cc by"),
    ]
    return spark.createDataFrame([(i, t, "en", "k", "s", "q") for i, t in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def write(spark, folder, docs, labels=(), bench=()):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def remainder(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


def words(text):
    """A-Z lower-cased; words are digits, a-z and everything outside ASCII."""
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
