"""Operators whose results another program can give: the tokenizer library, SQL, or brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.oracle import assert_same
from tidemark.llm import bpe_trie, chat_format, packing, quality, queries, url_filter
from tidemark.llm.common import words_hashes

SF = "/root/testdata/sf0.001"
HARD = ["", " ", "\n", "  a", "a  b", "a \nb", "a\n b", "a\n\nb", "a ", "don't we'll", "x<|endoftext|>y", "foo <|startoftext|> bar", "É́ß ﬁ 日本 ½ ²", "Σςσ İ", "\u0085a b　c", "12,345.67 #!%", "🎉🎉 ok", "H\u0331a A\u0300, ÀÉ. THE <|ENDOFTEXT|>", "a×. b÷, c—. é, É; ÿ!"]


def texts():
    rng = random.Random(5)
    letters = "abcthesinarouf éß  \n\t.,'12<|>"
    return HARD + ["".join(rng.choices(letters, k=rng.randint(0, 120))) for _ in range(400)] + ["word " * 3000]


@pytest.mark.parametrize("name", sorted(n for n in queries.ORACLES if n != "op8_suffix_dedup"))
def test_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


def test_bpe_is_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe_trie.TextEncoder(path)
    for text, (n, ids, decoded) in zip(texts(), own.encode(pa.array(texts())), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert bytes(ids).decode() == " ".join(map(str, want)) and n == len(want)
        assert bytes(decoded).decode() == library.decode(want, skip_special_tokens=False)


def test_byte_encoder_is_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), packing.ByteEncoder(path)
    for text, ids in zip(texts(), own(pa.array(texts())), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def rows_of(spark, rows):
    """Documents with a column that clashes with names inside the operators."""
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, k string")


def test_packing_holds_every_id_once(spark):
    docs = [(i, t) for i, t in enumerate(texts())] + [(1000, None), (1000, None), (None, "nulls")]
    pieces = packing.digests(packing.pack(rows_of(spark, docs))).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda p: p.start)
        if i != 1000:
            assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1].tolist()] and sum(p.length for p in own) == len(ids)
        for p in own:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    padding = 0
    for s in by_sequence.values():
        s.sort(key=lambda p: p.offset)
        total = sum(p.length for p in s)
        assert [p.offset for p in s] == [0, *np.cumsum([p.length for p in s])[:-1].tolist()] and total <= 1024
        padding += 0 if total & (total - 1) == 0 else 1024 - total
    assert padding < 0.02 * sum(p.length for p in pieces)
    assert packing.pack(rows_of(spark, [])).count() == 0


def test_chat_round_trip():
    for role, text in [("user", "<|im_end|>"), ("a\nb\\", r"<\|im_start|> <\\|x"), ("", ""), ("assistant", "é" * 10)]:
        [turn] = chat_format.read_back(chat_format.render(chat_format.Message(role, text)))
        assert (turn.role, turn.text, turn.in_loss) == (role, text, role == "assistant")
        assert chat_format.render(chat_format.Message(role, text)).count("<|im_") == 2


def test_chat_events_fold(spark):
    log = [
        (1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "assistant", None), (1, 1, 4, "delta", None, "lo"), (1, 1, 3, "delta", None, "hel"), (1, 2, 5, "delta", "assistant", "bad"),
        (1, 2, 6, "regenerate", None, None), (1, 2, 7, "delta", None, "good"), (1, 3, 8, "message", "user", "x"), (1, 3, 9, "edit", None, "y"), (None, None, None, None, None, None),
    ]
    got = {(r.conv_id, r.position): r.formatted for r in chat_format.format_turns(spark.createDataFrame(log, chat_format.EVENTS)).collect()}
    turns = [next(chat_format.read_back(got[1, i])) for i in range(4)]
    assert [(t.role, t.text) for t in turns] == [("user", "hi"), ("assistant", "hello"), ("assistant", "good"), ("user", "y")]
    assert got[None, 0] == "<|im_start|>\n<|im_end|>\n"
    assert chat_format.conversation_digests(spark.createDataFrame([], chat_format.EVENTS)).count() == 0


def test_chat_log_needs_folding(spark):
    """The log of some rows has all kinds of events, and folds back to them: nulls, ties, repeated rows, clashing columns, one long conversation."""
    rows = [(1, t, "user" if t % 2 else "assistant", f"text {t} é", "x") for t in range(200)]
    rows += [(2, None, None, None, "x"), (2, 1, "user", "b", "x"), (2, 1, "user", "a", "x"), (2, 1, "user", "a", "x"), (None, 1, "assistant", "z", "x")]
    log = chat_format.event_log(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, seq string"))
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"} and log.count() > 1.5 * len(rows)
    got = {}
    for r in sorted(chat_format.format_turns(log).collect(), key=lambda r: r.position):
        got.setdefault(r.conv_id, []).extend((t.role, t.text) for t in chat_format.read_back(r.formatted))
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in (1, 2, None):
        assert got[conv] == [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
    assert chat_format.event_log(spark.createDataFrame(rows[:0], "conv_id long, turn int, role string, text string, seq string")).count() == 0


def test_url_rules(spark):
    trie = url_filter.UrlTrie(url_filter.RULES)
    name = lambda h, p: (r := trie.find(h, p)) and r.name
    assert name("a.example.org", "/es/x") == "example.org/es/" and name("example.org", "/en/12") == "example.org/en/1" and name("org", "/") == "org/"
    assert name("org", "") is None and name("xorg", "/") is None and name("a.com", "/de/") == "com/de/" and name("a.com", "/de") is None
    urls = ["http://A.Example.org/es/1?q", "x", None, "://com/fr/", "ftp://b.com/de/#f", "http://org?x/y"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    first = sorted(map(tuple, url_filter.judge(df).collect()), key=lambda r: r[0])
    host, path = url_filter.host_and_path(df.url)
    second = url_filter.judge_by_join(df.select("page_id", host.alias("host"), path.alias("path")), list(url_filter.RULES), "page_id", "allow")
    assert first == sorted(map(tuple, second.collect()), key=lambda r: r[0])
    again = spark.createDataFrame([(1, urls[0], "h")] * 3 + [(None, urls[0], "h")], df.schema)
    host, path = url_filter.host_and_path(again.url)
    assert len(url_filter.judge(again).collect()) == 4 == url_filter.judge_by_join(again.select("page_id", host.alias("host"), path.alias("path")), list(url_filter.RULES), "page_id", "allow").count()
    assert url_filter.judge(df.limit(0)).count() == 0
    assert first[0][1:] == ("a.example.org", "/es/1", "example.org/es/", "block") and first[2][1:] == ("", "", None, "allow")


def brute_base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_quality_base():
    for t in [*texts(), "a b c d e\n" * 4, "x y\nx y\n\n\n"]:
        b = quality.base_counts(t.encode(), len(t), words_hashes(t.encode().split()))
        assert (b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words) == brute_base(t)


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(3)
    field = quality.LineField(rng.normal(size=(quality.N, 2)), rng.normal(size=(2, 2)))
    for n in range(1, 8):
        x = rng.random((n, quality.N))
        e = x @ field.emit
        score = lambda y: sum(e[i, y[i]] for i in range(len(y))) + sum(field.move[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        assert tuple(field.decode(x)) == max(itertools.product((0, 1), repeat=n), key=score)


def test_quality_accuracy_and_edges(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = quality.train(docs, labels.where("doc_id % 2 = 0"))
    held = quality.judge(docs, field).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in held]) > 0.97
    got = {r.doc_id: r for r in quality.judge(rows_of(spark, [(1, None), (None, "")]), quality.LineField.blank()).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[None].kept
    assert quality.keep(docs.limit(0), field).columns == docs.columns
    assert quality.judge(docs.limit(0), field).count() == 0
    # Content with boilerplate in its midst: the share lies between, and lines are told apart.
    rows = docs.join(labels, "doc_id").where("length(text) > 800").orderBy("doc_id").collect()
    good, bad = ([r.text.split("\n") for r in rows if r.quality == q and len(r.text.split("\n")) > 3][:40] for q in (1, 0))
    right, between = [], 0
    for g, b in zip(good, bad, strict=False):
        mixed = "\n".join(g[:2] + b + g[2:])
        label = field.decode(quality.line_features(mixed.encode())[0])
        right.append(np.mean(label == np.array([1] * 2 + [0] * len(b) + [1] * (len(g) - 2))))
        between += 0 < field.content_share(mixed.encode()) < 1
    assert len(right) > 20 and np.mean(right) > 0.9 and between > 0.9 * len(right)
    # Repeated rows, clashing columns, a line of great length, labels without a document and null labels.
    line = " ".join(["content words stand here"] * 30_000)
    again = quality.judge(rows_of(spark, [(1, line), (1, line), (2, "a b")]), field).collect()
    assert len(again) == 3 and again[0] == again[1]
    odd = spark.createDataFrame([(1, None), (10**9, 1), (0, 1), (0, 1)], "doc_id long, quality int")
    assert not quality.train(docs, odd).emit.any()
    empty = quality.train(docs, labels.limit(0))
    assert not empty.emit.any()


def test_digest_columns(spark):
    r = {x.doc_id: x for x in queries.QUERIES["op10_bpe"](spark, SF).collect()}
    d = spark.read.parquet(f"{SF}/documents.parquet").first()
    ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(d.text, add_special_tokens=False).ids
    assert r[d.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_bpe_table_edges(spark):
    """Null and empty texts, repeated rows, clashing columns, no rows, one chunk of great length, more chunks than are remembered."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    long = "abcé" * 5_000
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "x"), (4, long)]
    got = bpe_trie.encode(rows_of(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids, r.decoded) for r in got) == sorted(
        (i or -1, len(ids), ids, library.decode(ids, skip_special_tokens=False)) for i, ids in ((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    )
    assert bpe_trie.encode(rows_of(spark, [])).count() == 0
    encoder, most = bpe_trie.TextEncoder(public_tokenizers.path("word_bpe_49k.json")), bpe_trie.KNOWN
    bpe_trie.KNOWN = 50
    try:
        for part in (texts()[:200], texts()[200:]):
            for t, (n, _, _) in zip(part, encoder.encode(pa.array(part)), strict=True):
                assert n == len(library.encode(t, add_special_tokens=False).ids)
    finally:
        bpe_trie.KNOWN = most


def test_stretches_lose_no_window():
    """Anchors of texts that are looked at in stretches are those of whole texts."""
    from tidemark.llm import debruijn_dedup, suffix_dedup

    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcd", k=rng.randint(1, 6))) for _ in range(900)).encode()

    def windows(runs, ahead=0):
        return {(int(f) + j, int(h), int(p)) for _, hs, first, place, n in runs for h, f, p, k in zip(hs, first, place, n, strict=True) for j in range(int(k))}

    assert windows(suffix_dedup.text_anchors(100, 32, 200)([text, b"short"])) == windows(suffix_dedup.text_anchors(100, 32)([text, b"short"]))
    assert windows(debruijn_dedup.word_anchors(13, 5, 200)([text, b"a b"])) == windows(debruijn_dedup.word_anchors(13, 5)([text, b"a b"]))
    assert len(windows(suffix_dedup.text_anchors(100, 32, 200)([text]))) == len(text) - 99
