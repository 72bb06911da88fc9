"""Conversation repair, source divergence and token counts, against plain Python, SQL and the library itself."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import pairwise

import duckdb
import pytest
from pyspark.sql import functions as F

from roadflow.llm import divergence, repair, tokencounts
from roadflow.llm.queries import QUERIES, vocabulary_file

from . import messy

TURNS = "conv_id long, turn long, role string, text string"


def damaged(rows):
    """What the digest does to the rows, in the order of each conversation."""
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        kept += [(turn is not None, turn or 0, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {conv: [(t, r, x) for _, _, t, r, x in sorted(kept, key=lambda k: k[:2] + k[3:])] for conv, kept in convs.items()}


def cheapest(rows):
    """Least cost, then least audit, by trying all edits in that order; rows are (initial, must go, truncated)."""
    grammar = re.compile("(s?(ua)+)?")
    heap, steps = [(0, "", 0, "", ())], 0
    while True:
        cost, audit, at, roles, made = heapq.heappop(heap)
        steps += 1
        if at == len(rows) and grammar.fullmatch(roles):
            return cost, audit, made
        grow = lambda price, letter, n, role, what: heapq.heappush(
            heap, (cost + price, audit + letter, at + n, roles + role, made + what))
        fits = lambda role: any(grammar.fullmatch(roles + role + rest) for rest in ("", "a", "ua"))
        if at < len(rows):
            initial, gone, cut = rows[at]
            grow(3, "D", 1, "", ())
            if not gone:
                if initial in "sua" and fits(initial):
                    grow(cut, "K", 1, initial, ((at, None),))
                for role in "ua":
                    if fits(role):
                        grow(2 + cut, "R", 1, role, ((at, role),))
        for role in "ua":
            if fits(role):
                grow(2, "I", 0, role, ((None, role),))


def brute_repairs(rows):
    out = set()
    for conv, turns in damaged(rows).items():
        marks, seen, symbols = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in turns:
            solid = re.sub("[ \t\n\x0b\f\r]", "", text)
            fault = ("blank" if not solid else "duplicate" if (role, text) in seen else
                     "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                marks[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols.append((initial, fault in ("blank", "duplicate"), int(fault == "truncated")))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in pairwise(symbols))
        cost, audit, made = cheapest(symbols)
        names = {"u": "user", "a": "assistant"}
        lines = [f"{names.get(role) or turns[at][1]}:{'' if at is None else turns[at][2]}" for at, role in made]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.add((conv, gaps, marks["blank"], marks["duplicate"], marks["truncated"], illegal, cost, audit, digest))
    return out


def messy_turns():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "open end", "", " \t\n", None, "Why? ", "a.b", "日本。", "tail.\x85", "x" * 30_000]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "u", "assistant", "user"]), rng.choice(texts))
            for c in range(120) for t in rng.sample([None, -1, 0, 1, 2, 3, 4, 9], rng.randrange(1, 6))]
    rows += [(None, 0, "user", "Who."), (None, 1, "assistant", "Me."), (None, None, None, None)]
    return rows + rows[:12] + [(500, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(40)]


def results(df):
    return [tuple(r) for r in df.collect()]


def test_repair_against_all_edits(spark):
    rows = messy_turns()
    turns = spark.createDataFrame([(*r, "k", 1) for r in rows], TURNS + ", key string, fault int").repartition(7)
    got = results(repair.repair(repair.damage(turns)))
    want = brute_repairs([r for r in rows if r[0] != 500])
    assert {r for r in got if r[0] != 500} == want and len(got) == len(want) + 1
    assert repair.repair(repair.damage(turns.limit(0))).collect() == []


def test_repair_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = results(spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    got = results(QUERIES["op11_conversation_repair"](spark, folder))
    assert len(got) == len(set(got)) and set(got) == brute_repairs(rows)


def test_all_dropped_and_long_conversations(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows = [(c, 0, "user", "Hello.") for c in gone] + [(-7, t, "user", "Same.") for t in range(30_000)]
    got = {r[0]: r for r in results(repair.repair(repair.damage(spark.createDataFrame(rows, TURNS))))}
    for c in gone:
        assert got[c] == (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    # Repeats of one text must go (blank ones, too); what is left is the first whole and the first cut-off row.
    turns = damaged(rows)[-7]
    conv, _, blank, duplicate, truncated, _, cost, audit, _ = got[-7]
    assert blank == sum(not x for _, _, x in turns) and duplicate == len(turns) - blank - 2 and truncated == 1
    assert len(audit) - audit.count("I") == len(turns) and audit.count("D") == len(turns) - 2
    assert cost == 3 * (len(turns) - 2) + 2 * (audit.count("I") + audit.count("R")) + 1


def test_shared_endings_are_solved_once():
    endings = repair.Endings()
    words = ["uaua", "saua", "ua", "uuaua", "-aua", "uaua"]
    for w in sorted(w[::-1] for w in words):
        endings.plan(w)
    assert endings.solved == len({w[i:] for w in words for i in range(len(w))})
    for w in ("auau", "-a-su", "Xx", ""):
        rows = [(c.lower(), c == "-", int(c.isupper())) for c in w]
        assert endings.plan(w[::-1]) == cheapest(rows)[:2]


def audits(docs, min_docs):
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    return sorted(db.execute(divergence.report_sql(min_docs)).fetchall())


@pytest.mark.parametrize("min_docs, chunk, block", [(1, 32_768, 32), (2, 40, 2), (1000, 64, 32)])
def test_divergence_against_sql(spark, monkeypatch, min_docs, chunk, block):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TALLY", 50)
    monkeypatch.setattr(divergence, "PIECE", 64)
    names = [None, "", "a", "b", "é", "Z", "b2"]
    docs = messy.documents(spark).select(
        "doc_id", "text", F.element_at(F.array(F.lit(None), F.lit("en"), F.lit("")), F.pmod(F.xxhash64("text"), F.lit(3)).cast("int") + 1).alias("lang"),
        F.element_at(F.array(*[F.lit(n) for n in names]), F.pmod(F.xxhash64("doc_id", "text"), F.lit(7)).cast("int") + 1).alias("source"),
        F.lit(1).alias("n"), F.lit("x").alias("term"), F.lit(0).alias("total")).repartition(3)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert sorted(results(divergence.audit(docs, min_docs))) == audits(docs, min_docs)
    assert divergence.audit(docs.limit(0), min_docs).collect() == []


def test_counts_beyond_32_bits_stay_exact(spark):
    n, total, v = 7_000_000_000_000, 31_000_000_000_007, 12_345
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(divergence.probability("n", "total", "v")).first()
    assert row[0] == 1 + 10**9 * (n + 5) // (total + 5 * v)


@pytest.fixture(scope="module")
def spec():
    with open(vocabulary_file("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def library_counts(spec, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(spec)
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_token_counts_against_the_library(spark, spec, tmp_path):
    docs = messy.documents(spark)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(((i if i is not None else -1), len((t or "").encode()), n, n > 2048)
                  for (i, t), n in zip(texts, library_counts(spec, [t for _, t in texts])))
    got = tokencounts.count_tokens(docs, spec, str(tmp_path / "cache"))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    assert tokencounts.count_tokens(messy.empty(spark), spec, str(tmp_path / "none")).collect() == []


def test_only_distinct_misses_are_encoded(spark, spec, tmp_path):
    cache = str(tmp_path / "cache")
    stored = lambda: spark.read.parquet(cache)
    first = spark.createDataFrame([(1, "one  two"), (2, " one two\n"), (3, None), (4, "three")], "doc_id long, text string")
    assert len(tokencounts.count_tokens(first, spec, cache).collect()) == 4 and stored().count() == 3
    again = tokencounts.count_tokens(first, spec, cache)
    assert again.where("n_tokens > 0").count() == 3 and stored().count() == 3
    # What is stored is what is told: counts come from the table, not from the texts.
    version = tokencounts.tokenizer_version(spec)
    known = stored().where(F.col("digest") == tokencounts.digest(F.lit("three")))
    tokencounts.append(known.select("tokenizer", "digest", F.lit(77).cast("long").alias("n_tokens")), cache)
    more = spark.createDataFrame([(5, "three"), (6, "four")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in tokencounts.count_tokens(more, spec, cache).collect()} == {5: 77, 6: 1}
    assert stored().select("tokenizer").distinct().count() == 1 and stored().first().tokenizer == version
    # Another vocabulary file shares nothing with the first.
    other = spec.replace('"version":"1.0"', '"version": "1.0"', 1) if '"version":"1.0"' in spec else spec + "\n"
    assert tokencounts.count_tokens(more, other, cache).where("n_tokens = 77").count() == 0


def test_pieces_keep_the_librarys_counts(spec, monkeypatch):
    monkeypatch.setattr(tokencounts, "CACHED", 40)
    counter, rng = tokencounts.Counter(spec), random.Random(11)
    parts = ["a", "B", "'s", "'", "\n", " ", "7", "é", "É", "ß", "J̌", "İ", "Σ", "日", "<|endoftext|>", "<|ENDOFTEXT|>",
             "’", "\xa0", "²", "ª", "\x1c", "\x00", "Ɓ", "\U0001f600", "ing", "the"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(3000)]
    texts += [a + chr(k) + b for k in range(0x250) for a, b in (("a", "b"), ("", "'s"), ("1", ""))]
    plain = [re.sub(r"[\x09-\x0D\x20]+", " ", t).strip(" ") for t in texts]
    assert [counter.count(t) for t in plain] == library_counts(spec, texts)


def test_column_names_and_vocabularies_are_checked(spark, spec, tmp_path):
    docs = spark.createDataFrame([(1, "x", 2)], "doc_id long, text string, n_tokens int")
    with pytest.raises(ValueError):
        tokencounts.count_tokens(docs, spec, str(tmp_path / "c"), keep=("doc_id", "n_tokens"))
    with open(vocabulary_file(), encoding="utf-8") as file, pytest.raises(ValueError):
        tokencounts.check(file.read())


def test_heavy_keys_keep_all_rows(spark):
    from roadflow.llm.text import join_unique

    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    facts = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    joined = join_unique(rows, facts, "k")
    assert joined.count() == 5000 and joined.where("v <> k * 2").isEmpty()
