"""Language model, BPE, classifiers and the pipeline: brute force, round trips and held-out accuracy."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from roadflow.llm import bpe, hmm, neardup, quality, toxicity
from roadflow.llm.queries import QUERIES, vocabulary_file

from . import messy
from .test_text_queries import hits

tokenizers = pytest.importorskip("tokenizers")


def plain_likelihood(classes, chain):
    a, total = chain.start * chain.emit[:, classes[0]], 0.0
    for x in classes[1:]:
        total += math.log10(a.sum())
        a = (a / a.sum()) @ chain.move * chain.emit[:, x]
    return total + math.log10(a.sum())


def plain_counts(classes, chain):
    """Expected starts, transitions and emissions of one text, token by token."""
    n, f, b = len(classes), np.zeros((len(classes), hmm.STATES)), np.ones((len(classes), hmm.STATES))
    for i in range(n):
        f[i] = (f[i - 1] @ chain.move if i else chain.start) * chain.emit[:, classes[i]]
        f[i] /= f[i].sum()
    for i in range(n - 2, -1, -1):
        b[i] = chain.move @ (chain.emit[:, classes[i + 1]] * b[i + 1])
        b[i] /= b[i].sum()
    move, emit = np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.STATES, hmm.CLASSES))
    for i in range(n):
        emit[:, classes[i]] += f[i] * b[i] / (f[i] * b[i]).sum()
        if i:
            x = f[i - 1][:, None] * chain.move * (chain.emit[:, classes[i]] * b[i])
            move += x / x.sum()
    return f[0] * b[0] / (f[0] * b[0]).sum(), move, emit


@pytest.mark.parametrize("lengths", [(1, 63, 64, 65, 129, 700), (1,), (1, 2, 1), (64, 128)])
def test_segments_give_the_exact_likelihood_and_counts(lengths):
    rng = np.random.default_rng(0)
    chain = hmm.Chain.initial(np.full(hmm.CLASSES, 1 / hmm.CLASSES))
    texts = [rng.integers(0, hmm.CLASSES, n).astype(np.uint16) for n in lengths]
    part = hmm.Segments([t.tobytes() for t in texts])
    emissions = part.emissions(chain)
    alpha, beta, total = part.entries(chain, *part.transfers(chain, emissions))
    assert np.allclose(total, [plain_likelihood(t, chain) for t in texts], rtol=0, atol=1e-8)
    want = [sum(x) for x in zip(*(plain_counts(t, chain) for t in texts))]
    assert all(np.allclose(g, w) for g, w in zip(part.expected(chain, emissions, alpha, beta), want, strict=True))


def test_language_model(spark):
    docs = messy.documents(spark)
    got, rows = hmm.score(docs).collect(), docs.collect()
    tokens = lambda t: (t or "").encode().lower().split() + [b" "]
    counts = Counter(w for r in rows if messy.remainder(r.doc_id, 5) != 1 for w in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    want = sorted(((r.doc_id is None, r.doc_id or 0, len(tokens(r.text)), messy.remainder(r.doc_id, 5) == 1, sum(counts[w] > 0 for w in tokens(r.text)),
                    sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(r.text))) for r in rows))
    for r, w in zip(sorted(got, key=key), want, strict=True):
        assert (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.held_out, r.n_known, r.train_tokens) == (*w[:5], n)
        assert math.isclose(r.base_score, w[5], rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0
    assert hmm.score(messy.empty(spark)).collect() == []


def test_language_model_by_hand(spark, monkeypatch):
    """Scores of the whole operator against training and scoring token by token."""
    monkeypatch.setattr(hmm, "GAIN", 0.0)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * i + k * (i % 3 + 1)) % 29}" for k in range(i % 90))) for i in range(40)] + [(None, None)],
                                 "doc_id long, text string")
    rows = docs.collect()
    trained = [hmm.words_of(r.text) for r in rows if messy.remainder(r.doc_id, 5) != 1]
    counts = Counter(w for words in trained for w in words)
    own = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w)))}
    classes = lambda words: [own.get(w, hmm.bucket(w)) for w in words]
    shares = np.full(hmm.CLASSES, 0.5)
    for w, k in own.items():
        shares[k] += counts[w]
    shares /= shares.sum()
    chain = hmm.Chain.initial(shares)
    for _ in range(hmm.ROUNDS):
        chain = hmm.Chain.of_counts(*(sum(x) for x in zip(*(plain_counts(classes(w), chain) for w in trained))), shares)
    # No word is outside the frequent ones but unseen ones, each alone in its class with room for one word.
    want = {r.doc_id: plain_likelihood(classes(hmm.words_of(r.text)), chain) for r in rows}
    got = hmm.score(docs).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {sum(counts.values())}
    assert all(math.isclose(r.score, want[r.doc_id], abs_tol=1e-3) for r in got)


def test_rare_words_meet_their_counts(spark, monkeypatch):
    """The broadcast head only moves work: scores are the same without it."""
    often, once = [f"a{k}" for k in range(hmm.FREQUENT - 1)], [f"b{k}" for k in range(3000)]
    docs = spark.createDataFrame([(k, " ".join(often[k % 7 :: 7] * 3 + once[k % 7 :: 7])) for k in range(7)], "doc_id long, text string")
    docs = docs.unionByName(messy.documents(spark).select("doc_id", "text"))
    rows = lambda: sorted((str((r.doc_id, r.n_tokens, r.n_known)), r.base_score, r.score) for r in hmm.score(docs).collect())
    monkeypatch.setattr(hmm, "KNOWN", hmm.FREQUENT)
    few = rows()
    monkeypatch.setattr(hmm, "KNOWN", 10 * hmm.FREQUENT)
    for a, b in zip(rows(), few, strict=True):
        assert a[0] == b[0] and math.isclose(a[1], b[1], abs_tol=1e-6) and math.isclose(a[2], b[2], abs_tol=0.01)


def test_chain_learns(spark, small):
    rows = QUERIES["op4_language_model"](spark, small).where("held_out").collect()
    per_token = lambda c: sum(r[c] for r in rows) / sum(r.n_tokens for r in rows)
    assert per_token("score") > per_token("base_score")


def test_bpe_is_exact(spark, small):
    path = vocabulary_file()
    theirs = tokenizers.Tokenizer.from_file(path)
    docs = messy.documents(spark).unionByName(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    encoded = bpe.decode(bpe.encode(docs, path), path)
    for r in encoded.collect():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        assert r.tokens == ids and r.decoded == theirs.decode(ids, skip_special_tokens=False) == (r.text or "")
    got = {r.doc_id: r for r in bpe.report(encoded.where("doc_id = 14 and lang = 'en'")).collect()}[14]
    ids = theirs.encode(docs.where("doc_id = 14").first().text, add_special_tokens=False).ids
    assert got.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.decode(bpe.encode(messy.empty(spark), path), path).collect() == []


def test_bpe_in_one_pass_and_clashing_names(spark):
    path = vocabulary_file()
    docs = messy.documents(spark)
    one = bpe.round_trip(docs, path).select("doc_id", "text", "tokens", "decoded")
    two = bpe.decode(bpe.encode(docs, path), path).select("doc_id", "text", "tokens", "decoded")
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    with pytest.raises(ValueError):
        bpe.round_trip(docs.withColumn("tokens", docs.text), path)


@pytest.mark.parametrize("cached, trees, together", [(30, 7, 50), (100_000, 4096, 1_000_000)])
def test_bpe_trees_side_by_side(monkeypatch, cached, trees, together):
    import random

    monkeypatch.setattr(bpe, "CACHED", cached)
    monkeypatch.setattr(bpe, "TREES", trees)
    monkeypatch.setattr(bpe, "TOGETHER", together)
    codec, theirs = bpe.Codec(bpe.read_spec(vocabulary_file())), tokenizers.Tokenizer.from_file(vocabulary_file())
    rng = random.Random(2)
    parts = ["a", "th", "é", "日本", "  ", "\n", "ing", "'s", "x" * 70, "-", "=", "7", "🙂", "<|endoftext|>", "wh" * 33, None]
    texts = ["".join(p or "" for p in rng.choices(parts, k=rng.randrange(20))) for _ in range(500)] + [None]
    for packed, text in zip(codec.encode_all(texts), texts, strict=True):
        assert np.frombuffer(packed, np.int32).tolist() == theirs.encode(text or "", add_special_tokens=False).ids
    for piece in {"th" * k for k in range(1, 40)}:
        assert np.frombuffer(codec.encode(piece), np.int32).tolist() == codec.merge(piece.encode())


def test_bpe_on_odd_text():
    import random

    codec, theirs = bpe.Codec(bpe.read_spec(vocabulary_file())), tokenizers.Tokenizer.from_file(vocabulary_file())
    rng = random.Random(1)
    every = [*range(0xD800), *range(0xE000, 0x110000)]
    odd = [lambda: chr(rng.choice(every)), lambda: chr(rng.randrange(32, 127)), lambda: rng.choice(" \n\t\r\x1c\x85\u00a0\u2003"),
           lambda: rng.choice(["<|endoftext|>", "'re", " the", "é", "🙂", "12"]), lambda: chr(rng.randrange(0xA0, 0x600))]
    for _ in range(3000):
        text = "".join(rng.choice(odd)() for _ in range(rng.randrange(40)))
        assert np.frombuffer(codec.encode(text), np.int32).tolist() == theirs.encode(text, add_special_tokens=False).ids
    text = "ab" * 20_000
    assert np.frombuffer(codec.encode(text), np.int32).tolist() == theirs.encode(text, add_special_tokens=False).ids


def labelled_corpus(spark, folder):
    """Good prose, shouting and repetition as bad prose, and good prose with insults, some of them misspelt."""
    rng, rows, labels = np.random.default_rng(4), [], []
    for k in range(900):
        text, bad, toxic = messy.prose(80, 100 + k), k % 5 == 0, k % 7 == 3
        if bad:
            text = text.upper().replace(" ", "!! ") if k % 2 else " ".join([text.split()[0]] * 80)
        elif toxic:
            w = text.split()
            for at in range(5, 80, 25):
                stem = str(rng.choice(["wretch", "gobshite", "numbskull"]))
                cut = int(rng.integers(2, 5))
                w[at] = stem if rng.random() < 0.6 else stem[:cut] + stem[cut] * 2 + stem[cut + 1 :]
            text = " ".join(w)
        rows.append((k, text, "en", "k", "s", "q"))
        labels.append((k, int(not bad), int(toxic and not bad)))
    return messy.write(spark, folder, spark.createDataFrame(rows, messy.DOCS), labels, [(1, messy.prose(80, 101)[30:150])])


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    return labelled_corpus(spark, tmp_path_factory.mktemp("corpus"))


@pytest.mark.parametrize(("name", "label", "least"), [("op9_quality", "quality", 0.98), ("op2_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, corpus, name, label, least):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{corpus}/labels.parquet").collect()}
    rows = [r for r in QUERIES[name](spark, corpus).collect() if r.held_out]
    assert all(r.held_out == (messy.remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows) >= least


def rare_insults(n, seed):
    """Long texts of many words; one in eight holds two of a few rare ones."""
    rng = np.random.default_rng(seed)
    words = ["".join(np.random.default_rng(k).choice(list("abcdefghijklmnopqrstuvwxyz"), 4 + k % 6)) for k in range(6000)]
    share = 1 / np.arange(20, 6020)
    y = (rng.random(n) < 1 / 8).astype(np.int64)
    texts = []
    for toxic in y:
        text = list(rng.choice(words, 250, p=share / share.sum()))
        if toxic:
            text[100], text[200] = rng.choice(["achlicha", "achlichen", "bomented"], 2)
        texts.append(" ".join(text))
    return texts, y


def test_toxicity_is_trained_until_a_split_says_so():
    texts, y = rare_insults(1000, 1)
    model = toxicity.Model(*zip(*map(toxicity.bag, texts)), y)
    fresh, truth = rare_insults(500, 2)
    scorer = toxicity.Scorer(model.values, model.weights, model.bias)
    logits = np.array([scorer.logit(t) for t in fresh])
    found = logits > np.quantile(logits[truth == 0], 0.99)
    assert found[truth == 1].mean() > 0.7
    assert len(model.losses) > toxicity.PATIENCE and min(model.losses[-toxicity.PATIENCE :]) >= min(model.losses) - toxicity.GAIN


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_messy_rows(spark, corpus, module):
    docs = messy.documents(spark)
    model = module.train(spark, corpus, spark.read.parquet(f"{corpus}/documents.parquet"))
    scored = module.score(docs, model, "own")
    assert scored.columns == [*docs.columns, "own"] and scored.count() == docs.count()
    assert all(0 <= r.own <= 1 for r in scored.collect())
    assert module.score(messy.empty(spark), model).collect() == []


@pytest.mark.parametrize("name", ["op9_quality", "op2_toxicity"])
def test_no_labels(spark, tmp_path, name):
    folder = messy.write(spark, tmp_path / "none", messy.documents(spark), [(None, 1, 0), (1, None, None)])
    rows = QUERIES[name](spark, folder).collect()
    assert len(rows) == 22 and len({r.score for r in rows}) == 1


def test_pipeline_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").unionByName(messy.documents(spark).withColumn("doc_id", messy.F.col("doc_id") + 5000))
    docs = corpus_pipeline.stage(docs, "docs")
    bench = [tuple(r) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, function in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stage(function(spark, docs, corpus), name)
        rows, was = docs.collect(), before.collect()
        if name != "tokens":
            assert docs.columns == columns
        if name == "near_duplicates":
            kept = {r.key for r in neardup.groups(before).where("kept or n_shingles = 0 or component_id is null").collect()}
            assert len(rows) == len(kept) < len(was)
        if name == "decontamination":
            assert Counter(map(tuple, rows)) == Counter(tuple(r) for r in was if not hits(r.text, bench)[-1])
            assert len(rows) < len(was)
        if name == "tokens":
            assert all(r.decoded == (r.text or "") and r.n_tokens == len(r.tokens) for r in rows) and len(rows) == len(was)
        if name in ("quality", "toxicity"):
            assert 0 < len(rows) < len(was)
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, messy.empty(spark), corpus).count() == 0


def test_pipeline_with_clashing_names(spark, corpus):
    names = ("tokens", "n_tokens", "decoded", "quality", "toxicity", "score", "_quality", "_toxicity")
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(60)
    for k, c in enumerate(names):
        docs = docs.withColumn(c, messy.F.lit(f"own {k}"))
    docs, columns = corpus_pipeline.stage(docs, "docs"), docs.columns
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, corpus), name)
        assert docs.columns[:len(columns)] == columns
    for r in docs.collect():
        assert all(r[c] == f"own {k}" for k, c in enumerate(names)) and r.decoded_ == r.text and r.n_tokens_ == len(r.tokens_)


def test_pipeline_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and all(r.decoded == r.text for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)
