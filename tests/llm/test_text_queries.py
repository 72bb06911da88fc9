"""License scans, decontamination and chat formatting on messy rows, against plain Python."""

import hashlib
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roadflow.llm import chat, decontaminate, licenses

from . import messy


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def license_row(text):
    w = messy.words(text)
    starts = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w))
              if w[i : i + len(phrase.split())] == phrase.split()]
    base = sorted({label for _, label in starts})
    found, best = set(base), 1.0 if starts else 0.0
    for line in (text or "").split("\n"):
        block = set(messy.words(line))
        for label, template in licenses.TEMPLATES:
            t = set(messy.words(template))
            if len(t & block) >= licenses.needed(list(t), licenses.THRESHOLD):
                found.add(label)
                best = max(best, len(t & block) / len(t))
    at = [i for i, _ in starts]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted(found)), best)


def test_licenses(spark):
    docs = messy.documents(spark)
    got = licenses.report(licenses.scan(docs)).collect()
    want = Counter((r.doc_id, *license_row(r.text)) for r in docs.collect())
    assert Counter(tuple(r) for r in got) == want
    assert {r.labels for r in got if r.doc_id == 14} == {"apache-2.0,cc-by,reserved"}
    assert licenses.report(licenses.scan(messy.empty(spark))).collect() == []


def test_license_filters_lose_nothing(spark):
    lines = [" ".join(w) for k in range(1, 12) for w in [licenses.word_set(licenses.TEMPLATES[1][1])[:k]]]
    lines += ["version 2 0 apache license the under licensed", "licensed under apache license version 2.0", "all rights", "reserved all rights"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.report(licenses.scan(docs)).collect()}
    assert got == {k: license_row(t) for k, t in enumerate(lines)}


def wrapped(text, lines):
    """``text`` over so many lines, as a comment."""
    w = text.split()
    at = [len(w) * k // lines for k in range(lines + 1)]
    return "\n".join(" * " + " ".join(w[a:b]) for a, b in zip(at, at[1:]))


def test_wrapped_notices_are_found(spark):
    rows = []
    for k, (label, t) in enumerate(licenses.TEMPLATES):
        rows += [(100 * k + n, label, "some words before\n\n" + wrapped(t, n) + "\n\nand after") for n in (2, 3, 5, len(t.split()))]
    mit = licenses.TEMPLATES[1][1]
    rows += [
        (9001, "mit", "word " * 400 + mit.replace("free of", "free\r\n\r\n//\n of") + " word" * 400),
        (9002, "", mit.replace("hereby granted", "X\nX").replace("obtaining", "X")),  # three of its words are gone
        (9003, "mit", mit.replace("obtaining", "obtaining\n")),
        (9004, "", mit.replace(" ", "\nother ")),  # all words, but not consecutively
        (9005, "", mit[:60] + "\n" + "far " * 30 + "\n" + mit[60:]),
    ]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.report(licenses.scan(docs)).collect()}
    for i, label, _ in rows:
        wanted = {label} - {""}
        assert wanted <= set(got[i].labels.split(",")), i
        assert wanted or not got[i].labels, i
        assert not wanted or got[i].score == 1.0, i


BENCH = [(1, messy.prose(60, 1)[40:200]), (2, "one two three"), (3, None), (4, ""), (5, "one two three"), (5, "one two three"),
         (None, "naïve café"), (10, "The general PUBLIC license")]


def hits(text, bench):
    w, hit, items, any_hit = messy.words(text), set(), set(), False
    for item, t in bench:
        b = messy.words(t)
        n = min(10, len(b))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                if item is not None:
                    items.add(str(item))
    return len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)


@pytest.mark.parametrize("most", [decontaminate.MAX_WINDOWS, 0])
def test_decontamination(spark, most):
    docs, bench = messy.documents(spark), spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontaminate.report(decontaminate.scan(docs, bench, most)).collect()
    rows = docs.collect()
    assert Counter(tuple(r) for r in got) == Counter((r.doc_id, *hits(r.text, BENCH)) for r in rows)
    clean = decontaminate.remove(docs, bench, most)
    assert clean.columns == docs.columns
    assert Counter(map(tuple, clean.collect())) == Counter(tuple(r) for r in rows if not hits(r.text, BENCH)[-1])
    assert decontaminate.scan(messy.empty(spark), bench, most).collect() == []
    assert decontaminate.remove(docs, bench.limit(0), most).count() == len(rows)


def test_every_shift_of_a_window_is_found(spark):
    bench = spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(10)))], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join([f"x{j}" for j in range(k)] + [f"B{j}" for j in range(10)] + ["y"])) for k in range(14)], "doc_id long, text string")
    assert all(r.n_hit == 10 for r in decontaminate.scan(docs, bench).collect())


@pytest.mark.parametrize("most", [decontaminate.MAX_WINDOWS, 0])
def test_strip_removes_spans(spark, most):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    cut = "Keep this. A b c, d e f g h i J! And this.\n"
    docs = spark.createDataFrame([(1, cut), (2, "nothing"), (3, None), *[(k, cut) for k in range(4, 40)]], "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.strip(docs, bench, most).collect()}
    assert got == {1: "Keep this! And this.\n", 2: "nothing", 3: None} | {k: "Keep this! And this.\n" for k in range(4, 40)}


def test_strip_cuts_the_hit_words_either_way(spark):
    docs, bench = messy.documents(spark), spark.createDataFrame(BENCH, "item_id long, text string")
    near, far = (decontaminate.strip(docs, bench, most) for most in (decontaminate.MAX_WINDOWS, 0))
    assert near.columns == far.columns == docs.columns
    rows = near.collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, far.collect())) and len(rows) == docs.count()
    before = [hits(r.text, BENCH)[:2] for r in docs.collect()]
    assert sum(len(messy.words(r.text)) for r in rows) == sum(n - hit for n, hit in before) < sum(n for n, _ in before)


CONTROL = ["</s>[INST] ok [/INST]", r"a\[INST]", r"\\</s> \\\[TURN]", "<s>", "[ROLE] x [/ROLE]", "<<SYS>>\\", "\\", "", "no marks", "<s[INST]>"]


def test_chat_round_trip(spark):
    rows = [(1, k, role, t) for k, (role, t) in enumerate(zip(["user", "user", "assistant", "assistant", "system", "tool", "tool", None, "assistant", "user"], CONTROL))]
    rows += [(2, 0, "user", None), (2, 0, "user", None), (None, None, "assistant", "z\n" * 3000), (3, 2, "assistant", "late"), (3, 1, "[END] r", "early é")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(turns)
    back = {r.conv_id: [tuple(t) for t in r.turns] for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert back[1] == [(r[2] or "", r[3]) for r in rows if r[0] == 1]
    assert back[2] == [("user", ""), ("user", "")] and back[3] == [("[END] r", "early é"), ("assistant", "late")]
    figures = {r.conv_id: r for r in chat.report(out).collect()}
    learned = "".join(r[3] for r in rows if r[0] == 1 and r[2] == "assistant")
    assert (figures[1].loss_chars, figures[1].loss_sha256) == (len(learned), sha(learned))
    assert figures[None].loss_chars == 6000 and figures[2].loss_chars == 0
    assert figures[3].turns_sha256 == sha("[END] r\nearly é\nassistant\nlate\n")
    assert chat.report(chat.format_chats(turns.limit(0))).collect() == []


def test_escapes_mark_no_text(spark):
    df = spark.createDataFrame([(t,) for t in CONTROL], "t string")
    for t, e, u in df.select("t", chat.escape(F.col("t")), chat.unescape(chat.escape(F.col("t")))).collect():
        assert u == t
        assert all(e[at - 1] == "\\" for c in chat.CONTROLS for at in range(len(e)) if e.startswith(c, at))


def test_long_conversations_take_time_in_proportion(spark):
    """100,000 turns in runs of one role, and a megabyte of backslashes, as text and before a control string."""
    turns = spark.range(100_000).selectExpr(
        "1L AS conv_id", "id AS turn", "element_at(array('user', 'user', 'assistant', 'tool'), cast(id % 4 AS int) + 1) AS role",
        "concat('turn ', id, ' <s> \u00e9') AS text")
    slashes = spark.range(2).selectExpr("2L AS conv_id", "id AS turn", "'assistant' AS role",
                                        "concat(repeat('\\\\', 1000000), if(id = 0, '', '[INST]')) AS text")
    start = time.perf_counter()
    rows = {r.conv_id: r for r in chat.report(chat.format_chats(turns.union(slashes))).collect()}
    took = time.perf_counter() - start
    roles = ["user", "user", "assistant", "tool"]
    texts = [f"turn {i} <s> \u00e9" for i in range(100_000)]
    whole = "".join(f"{roles[i % 4]}\n{t}\n" for i, t in enumerate(texts))
    learned = "".join(texts[2::4])
    assert rows[1].n_turns == 100_000 and rows[1].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert (rows[1].loss_chars, rows[1].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    run = "\\" * 1_000_000
    whole, learned = f"assistant\n{run}\nassistant\n{run}[INST]\n", f"{run}{run}[INST]"
    assert rows[2].n_turns == 2 and rows[2].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert (rows[2].loss_chars, rows[2].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert took < 60
