"""Operators over whole corpora against brute force on small fixtures with nulls, copies, ties and clashing columns."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import audio_fingerprint, debruijn_dedup, lm_mixing, minhash, suffix_dedup
from tidemark.llm.common import Scratch, words_hashes


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    docs = [" ".join(word() for _ in range(rng.randint(1, 200))) for _ in range(40)]
    docs += [docs[0]] * 5 + [f"{word()} {passage} {word()}" for _ in range(8)] + [passage + " " + passage]
    for i in range(12):  # near copies of one text
        words = docs[1].split() + docs[2].split()
        words[rng.randrange(len(words))] = word()
        docs.append(" ".join(words))
    docs += ["", None, "one", "One", "a b c", "x" * 250, "x" * 250 + "y", "\n".join(["same line here"] * 30)]
    rows = [(i, t) for i, t in enumerate(docs)]
    return [*rows, rows[3], (None, docs[4]), (None, "alone " * 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", 0) for i, t in corpus()], "doc_id long, text string, sha string, v int")


def brute_suffix(rows, length=100):
    big = 2**63
    seen, out = {}, {}
    for i, t in sorted({(big if i is None else i, t or "") for i, t in rows}):
        data = t.encode()
        hit = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            if seen.setdefault(data[s : s + length], (i, s)) != (i, s):
                hit[s : s + length] = True
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~hit])
        out[None if i == big else i, len(data)] = (int(hit.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, docs):
    want = brute_suffix(corpus())
    got = suffix_dedup.digests(docs, Scratch(spark, "t")).collect()
    assert len(got) == len(corpus())
    assert {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert suffix_dedup.digests(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_suffixes_are_sorted():
    data = np.frombuffer(b"abracadabra" * 20 + b"zabracad" + bytes(100), np.uint8)
    n = len(data) - 100
    places, pointers = suffix_dedup.window_buckets(data, np.array([0]), np.array([n]), 100)
    windows = [data[p : p + 100].tobytes() for p in places]
    order = np.argsort(pointers, kind="stable")
    assert [windows[i] for i in order] == sorted(windows)
    assert len(set(zip(pointers.tolist(), windows, strict=True))) == len(set(windows)) == len(set(pointers.tolist()))


def test_debruijn_dedup(spark, docs):
    first, want = {}, {}
    big = 2**63
    rows = [(big if i is None else i, (t or "").encode().split()) for i, t in corpus()]
    for i, w in rows:
        for s in range(len(w) - 12):
            key = tuple(w[s : s + 13])
            first[key] = min(first.get(key, big), i)
    for i, w in rows:
        gone = {s + j for s in range(len(w) - 12) if first[tuple(w[s : s + 13])] < i for j in range(13)}
        want[None if i == big else i, len(w)] = (len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    got = debruijn_dedup.digests(docs, Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_words): (r.n_removed, r.kept_sha256) for r in got} == want
    assert debruijn_dedup.digests(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_near_duplicates(spark, docs):
    big = 2**63 - 1
    sets = []
    for i, t in corpus():
        w = (t or "").lower().split() if (t or "").isascii() else (t or "").encode().lower().split()
        w = [x if isinstance(x, bytes) else x.encode() for x in w]
        sets.append((big if i is None else i, {tuple(w[s : s + 4]) for s in range(len(w) - 3)} or ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(docs, Scratch(spark, "t")).collect()
    assert len(got) == len(sets)
    out = lambda x: None if x == big else x
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((out(i), len(s), out(find(i))) for i, s in sets)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_posterior_floor_loses_few():
    floor = minhash.posterior_floor(175, 80, 1e-6)
    assert sum(math.comb(176, m) * 0.8**m * 0.2 ** (176 - m) for m in range(floor)) < 1e-6
    assert minhash.bands() == 27


def test_language_model(spark, docs):
    got = {(r.doc_id, r.n_tokens): r for r in lm_mixing.score(docs, Scratch(spark, "t"), head=20).collect()}
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    seen = Counter()
    for i, t in corpus():
        if not held(i):
            seen.update(tokens(t))
    n, v = sum(seen.values()), len(seen)
    for i, t in corpus():
        r = got[i, len(tokens(t))]
        assert (r.held_out, r.n_known, r.train_tokens) == (held(i), sum(w in seen for w in tokens(t)), n)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(t)))
        assert r.score < 0
    assert lm_mixing.score(docs.limit(0), Scratch(spark, "t")).count() == 0


def head_model(texts):
    """A model of heads that has counted and fitted some texts."""
    words = Counter(w for t in texts for w in t.encode().lower().split())
    top = [w for w, _ in words.most_common(20)]
    hashes = words_hashes(top)
    order = np.argsort(hashes)
    pairs = np.full(1 << 16, -1, np.int64)
    two = sorted({w[:2] for w in words if len(w) > 1 and w not in top})[:30]
    for i, w in enumerate(two):
        pairs[w[0] << 8 | w[1]] = i
    counts = np.concatenate([np.array([words[w] for w in top])[order], np.full(len(two) + 256, 3), [len(texts)]])
    heads = lm_mixing.Heads(hashes[order], pairs, lm_mixing.Code.of(counts))
    model = lm_mixing.HeadModel(heads, lm_mixing.Predictors(lm_mixing.HEAD_BITS, lm_mixing.blank_counts(lm_mixing.HEAD_BITS)), lm_mixing.Mixer.blank(len(lm_mixing.HEAD_BITS) + 1, lm_mixing.LEVELS**3))
    model.count(pa.array(texts), model.tables.counts)
    model.tables.settle()
    model.score(lm_mixing.Text.of(pa.array(texts[:30]), heads), learn=True)
    return model


def test_head_scores_by_brute_force():
    """Decision by decision and text by text, in plain Python."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, weights=range(1, 61), k=n)) for n in (0, 1, 5, 40, 70, 200, 300) * 8]
    model = head_model(texts)
    got = model.score(lm_mixing.Text.of(pa.array(texts), model.heads))
    for text, want in list(zip(texts, got, strict=True))[:7] + [(texts[3], got[3])]:
        t = lm_mixing.Text.of(pa.array([text]), model.heads)
        contexts, code = t.contexts(model.heads.end), model.heads.code
        total, so_far, change, seen, block, at = 0.0, Counter(), np.zeros(5), 0, 32, 0
        while at < len(t.heads):
            size = block if at == 0 else min(at, lm_mixing.LAST_BLOCK)
            later, slope, fresh = Counter(), np.zeros(5), 0
            for i in range(at, min(at + size, len(t.heads))):
                for d in range(code.start[t.heads[i]], code.start[t.heads[i] + 1]):
                    node, bit = int(code.node[d]), int(code.bit[d])
                    slots = [int(s[0]) for s in lm_mixing.slots_of([c[i : i + 1] for c in contexts], np.zeros(1, np.int64), np.array([node]), lm_mixing.HEAD_BITS)]
                    pairs = [model.tables.counts[k][2 * s : 2 * s + 2].astype(float) for k, s in enumerate(slots)] + [np.array([so_far[node, 0], so_far[node, 1]], float)]
                    x = np.array([math.log((n1 + 0.4) / (n0 + 0.4)) for n0, n1 in pairs])
                    gate = 0
                    for n0, n1 in pairs[-3:]:
                        gate = gate * lm_mixing.LEVELS + sum(n0 + n1 >= e for e in lm_mixing.LEVEL_ENDS)
                    z = float(np.clip((model.mixer.weights[:, gate] + change) @ x, -11.9, 11.9))
                    total -= float(lm_mixing.cost(model.mixer.refined(np.array([z], np.float32), np.array([gate])), np.array([bit]))[0])
                    slope += (bit - 1 / (1 + math.exp(-z))) * x
                    later[node, bit] += 1
                    fresh += 1
            so_far, seen = so_far + later, seen + fresh
            change = change + lm_mixing.PULL * slope / (seen + 400)
            at += size
        assert total == pytest.approx(want, rel=1e-3)


def test_heads_and_spelling_are_distributions():
    """The chances of all heads add up to one after any tokens, and so do those of all bytes."""
    rng = np.random.default_rng(1)
    code = lm_mixing.Code.of(rng.integers(1, 1000, 300))
    assert sum(2.0 ** -(b - a) for a, b in zip(code.start, code.start[1:])) == pytest.approx(1)
    mixer = lm_mixing.Mixer.blank(4)
    mixer.weights = rng.normal(size=mixer.weights.shape).astype(np.float32)
    mixer.refine = rng.normal(size=mixer.refine.shape).astype(np.float32)
    tables = lm_mixing.Predictors(lm_mixing.HEAD_BITS, [rng.integers(0, 9, 2 << b).astype(np.uint32) for b in lm_mixing.HEAD_BITS]).settle()
    owner, node, bit = code.bits(np.arange(300))
    contexts = [np.full(300, c, np.uint64) for c in (0, 5, 6, 7)]
    x, gate = tables.inputs(lm_mixing.slots_of(contexts, owner, node, lm_mixing.HEAD_BITS))
    costs = np.bincount(owner, lm_mixing.cost(mixer.refined(mixer.mixed(x, gate), gate), bit), 300)
    assert np.exp(-costs).sum() == pytest.approx(1, rel=1e-3)


def test_weights_are_fitted_on_every_training_text(spark):
    """Long ones and all others: every decision is among what the weights come from, at the place that it has in its task."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, weights=range(1, 61), k=n)) for n in (0, 1, 300, 30_000, 40, 2000)]
    heads = head_model(texts).heads
    docs = spark.createDataFrame([(t, i == 2) for i, t in enumerate(texts)], "text string, held_out boolean").coalesce(1)
    got = lm_mixing.learn_sequence(docs, heads)
    training = pa.array([t for i, t in enumerate(texts) if i != 2])
    alone = lm_mixing.HeadModel(heads, lm_mixing.Predictors(lm_mixing.HEAD_BITS, []), lm_mixing.Mixer.blank(1))
    fit, total, whole = lm_mixing.Fit.blank(5, lm_mixing.LEVELS**3), lm_mixing.blank_counts(lm_mixing.HEAD_BITS), lm_mixing.blank_counts(lm_mixing.HEAD_BITS)
    for part in lm_mixing.parts_of(training, 0):
        alone.learn(part, total, fit)
        fit.settle()
    alone.count(training, whole)
    assert all((a == b).all() for a, b in zip(total, whole, strict=True))
    assert fit.met.sum() == len(heads.code.bits(lm_mixing.Text.of(training, heads).heads)[0])
    assert np.allclose(got.mixer.weights, fit.mixer.weights, atol=1e-3) and np.allclose(got.mixer.refine, fit.mixer.refine, atol=1e-3)
    assert (got.tables.odds[0] == lm_mixing.Predictors(lm_mixing.HEAD_BITS, whole).settle().odds[0]).all()
    fewer = lm_mixing.learn_sequence(docs.where("length(text) < 50000"), heads)
    assert not np.allclose(got.mixer.weights, fewer.mixer.weights, atol=1e-3)


def test_newton_terms_add_up():
    """One step on sums of parts is the step on all decisions; sums that tasks send are those."""
    rng = np.random.default_rng(4)
    x, gate, bit = rng.normal(size=(3, 5000)).astype(np.float32), rng.integers(0, 25, 5000), rng.integers(0, 2, 5000)
    want = lm_mixing.Mixer.blank(3)
    want.learn(x, gate, bit, rounds=1)
    parts = [lm_mixing.Fit.blank(3, 25) for _ in range(3)]
    for i, fit in enumerate(parts):
        fit.add(x[:, i::3], gate[i::3], bit[i::3].astype(np.int8))
    raw = sum(np.frombuffer(fit.dump(), "<i8") for fit in parts)
    got = lm_mixing.Fit.blank(3, 25).load(raw.tobytes())
    assert np.allclose(got.settle().weights, want.weights, atol=1e-3) and got.met.sum() == 5000


def test_language_model_looks_up_little():
    """What a decision costs: its nodes' counts lie together, one look gives log-odds and level, and what is made at once stays small."""
    code = lm_mixing.Code.of(np.random.default_rng(2).integers(1, 1000, 300))
    paths = [code.node[a:b] for a, b in zip(code.start, code.start[1:], strict=False)]
    assert len({tuple(p[:i]) for p in paths for i in range(1, len(p) + 1)}) == len(set(code.node.tolist())) == 299
    assert all(len(set((p[i : i + 3] >> 3).tolist())) == 1 for p in paths for i in range(0, len(p), 3))
    rng = np.random.default_rng(3)
    tables = lm_mixing.Predictors(lm_mixing.SPELL_BITS, [rng.integers(0, 30, 2 << b).astype(np.uint32) for b in lm_mixing.SPELL_BITS]).settle().opened()
    slots = [rng.integers(0, 1 << b, 5000) for b in lm_mixing.SPELL_BITS]
    x, gate = tables.inputs(slots)
    assert all((x[i] == o[s].astype(np.float32)).all() for i, (o, s) in enumerate(zip(tables.odds, slots, strict=True)))
    assert (gate == tables.seen[0][slots[-2]].astype(int) * lm_mixing.LEVELS + tables.seen[1][slots[-1]]).all()
    texts = [" ".join(random.Random(i).choices(["a", "bc", "def", "é"], k=2000)) for i in range(40)]
    model = head_model(texts)
    t = lm_mixing.Text.of(pa.array(texts), model.heads)
    model.tables = model.tables.opened()
    tracemalloc.start()
    model.score(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20


def test_hashes_are_found():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 20, 513, 40_000):
        known = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        hashes = np.concatenate([known[::3], rng.integers(0, 1 << 64, 500, np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        at, hit = lm_mixing.Found(known)(hashes)
        assert (hit == np.isin(hashes, known)).all() and (known[at[hit]] == hashes[hit]).all()


def test_blocks_double():
    place = np.arange(20_000)
    b = lm_mixing.blocks(place)
    size = np.bincount(b)
    assert size[:8].tolist() == [32, 32, 64, 128, 256, 512, 1024, 2048] and (np.diff(b) >= 0).all() and size[8:-1].max() == lm_mixing.LAST_BLOCK == size[8:-1].min()


def test_language_model_beats_add_one_on_held_out_texts(spark):
    """The score of new texts whose words were mostly met, in a corpus of two languages with repeated passages."""
    r = lm_mixing.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), Scratch(spark, "t")).groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n"), F.sum("base_score").alias("b"))
    by = {x.held_out: x for x in r.collect()}
    assert by[True].s / by[True].n > -4.3 and by[False].s > by[False].b


def test_fingerprints_align(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=200)
    rows = [(50, base[:64].tolist()), (1, base[:64].tolist()), (2, base[8:72].tolist()), (3, rng.normal(size=64).tolist()), (4, None), (5, [0.1]), (6, [None] * 64), (None, rng.normal(size=64).tolist())]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, frames int")
    got = {r.vec_id: r for r in audio_fingerprint.search(audio_fingerprint.fingerprints(df, "vec_id", "embedding", vectors=True)).collect()}
    assert len(got) == len(rows)
    assert (got[1].class_id, got[1].query_id, got[1].bit_errors, got[1].class_size) == (1, 50, 0, 2)
    assert got[2].query_id == 50 and got[2].offset == -16 and got[2].bit_errors < 0.2 * 32 * got[2].overlap
    assert got[3].query_id is None and got[4].class_id is None and got[5].n_frames == 0
    empty = audio_fingerprint.fingerprints(df.limit(0), "vec_id", "embedding", vectors=True)
    assert empty.count() == 0 and audio_fingerprint.search(empty).count() == 0
    # Rows of one id are recordings each; of equal matches the smallest query is the best.
    again = spark.createDataFrame([(7, base[:64].tolist(), 0)] * 2 + [(50, base[:64].tolist(), 0), (100, base[:64].tolist(), 0), (8, [float("nan")] * 64, 0)], df.schema)
    found = audio_fingerprint.search(audio_fingerprint.fingerprints(again, "vec_id", "embedding", vectors=True)).where("best_query").collect()
    assert sorted(r.vec_id for r in found) == [7, 7, 8, 50, 100] and {r.query_id for r in found if r.vec_id == 7} == {50}


def brute_alignments(prints, most_errors=30, least_overlap=32):
    """(q, class_id) -> {offset: (agreeing less differing bits, errors, overlap, votes)} of all offsets that match."""
    names = {}
    for i, f in prints:
        if f:
            names.setdefault(tuple(f), []).append(i)
    known = [(min(ids), any(i % 50 == 0 for i in ids), np.array(f, np.int64)) for f, ids in names.items()]
    out = {}
    for q, is_query, a in known:
        for c, _, b in known:
            for o in range(least_overlap - len(a), len(b) - least_overlap + 1) if is_query and q != c else ():
                x, y = a[max(-o, 0) :], b[max(o, 0) :]
                n = min(len(x), len(y))
                wrong = np.bitwise_count(x[:n] ^ y[:n])
                if n >= least_overlap and 100 * wrong.sum() <= 32 * n * most_errors:
                    out.setdefault((q, c), {})[o] = (32 * n - 2 * int(wrong.sum()), int(wrong.sum()), n, int((wrong == 0).sum()))
    return out


def test_fingerprint_matches_are_all_found(spark):
    """Against brute force over all offsets: bits flipped until hardly an integer is shared, shifts, lengths of all kinds."""
    rng = np.random.default_rng(4)
    flipped = lambda f, share: f ^ (rng.random((len(f), 32)) < share) @ (1 << np.arange(32))
    base = rng.integers(0, 1 << 32, 300)
    rows = [(0, base[:120]), (50, flipped(base[40:200], 0.03)), (100, base[:120]), (150, rng.integers(0, 1 << 32, 90)), (7, base[:120])]
    rows += [(i, flipped(base[s : s + n], share)) for i, s, n, share in ((1, 0, 120, 0.24), (2, 60, 100, 0.24), (3, 85, 70, 0.22), (4, 0, 300, 0.25), (5, 30, 32, 0.2), (6, 0, 31, 0.0), (8, 10, 120, 0.4))]
    rows += [(9, rng.integers(0, 1 << 32, 150)), (11, np.zeros(0, np.int64))]
    want = brute_alignments([(i, f.tolist()) for i, f in rows])
    prints = spark.createDataFrame([(i, f.tolist()) for i, f in rows], "id long, frames array<bigint>")
    met = audio_fingerprint.alignments(audio_fingerprint.classes(prints)).collect()
    assert len(met) == len(want) == len({(r.q, r.class_id) for r in met}) and len(want) > 8
    for r in met:
        offsets = want[r.q, r.class_id]
        assert offsets[r.offset][1:] == (r.bit_errors, r.overlap, r.votes) and offsets[r.offset] >= (max(offsets.values())[0],)
    # Every match is in the result, those of several queries and of two queries as well, and every recording once as best.
    got = audio_fingerprint.search(prints).collect()
    assert sorted(r.vec_id for r in got if r.best_query) == sorted(i for i, _ in rows)
    pairs = {(r.query_class_id, r.class_id) for r in got if r.query_id is not None and r.query_class_id != r.class_id}
    assert pairs == set(want) and {(0, 50), (50, 0)} <= pairs and any(len({q for q, c in pairs if c == i}) > 1 for i in range(1, 9))
    assert {r.vec_id: r.class_id for r in got if r.best_query and r.class_size == 3} == {0: 0, 7: 0, 100: 0}


def test_fingerprint_recall_on_a_table(spark):
    prints = audio_fingerprint.fingerprints(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), "vec_id", "embedding", vectors=True)
    prints = Scratch(spark, "t").settle(prints, "prints")
    want = set(brute_alignments([(r.id, r.frames) for r in prints.collect()]))
    got = {(r.q, r.class_id) for r in audio_fingerprint.alignments(audio_fingerprint.classes(prints)).collect()}
    assert want and got == want


def test_pipeline_keeps_its_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now
        now = Scratch(spark, "t").settle(stage(spark, now, "/root/testdata/sf0.001"), name)
        assert now.columns == columns and 0 < now.count() <= before.count()
    ids = {r.doc_id for r in now.select("doc_id").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "/root/testdata/sf0.001")
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids


def test_pipeline_near_duplicates_by_five_words(spark):
    """Against brute force. Of the last two texts 33 of 41 four-word shingles are shared, but 31 of 41 five-word ones."""
    import corpus_pipeline

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    words = [f"w{i}" for i in range(40)]
    rows += [(10_000, " ".join(words)), (10_001, " ".join([*words[:20], "other", *words[21:]]))]
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[s : s + 5]) for s in range(len(w) - 4)} or ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for at, (i, a) in enumerate(sets):
        for j, b in sets[:at]:
            if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "/root/testdata/sf0.001")
    assert {r.doc_id for r in got.collect()} == {i for i, _ in sets if find(i) == i}
    assert find(10_001) == 10_001


def test_pipeline_stages_start_with_a_small_heap(spark):
    """What a step before has left in the heap is given back before a stage begins."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    old = lambda: max(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    cores = spark.sparkContext.defaultParallelism
    for _, stage in corpus_pipeline.STAGES:
        before = old()
        stage(spark, docs, "/root/testdata/sf0.001")
        assert old() - before >= cores
