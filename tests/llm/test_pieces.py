import random
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from brackwater.llm import pieces

TEXTS = [
    "", " ", "  two  spaces ", "Hello, world!", "line\n\nbreaks\n", "äöü ß Ελλάδα Привет 日本語", "emoji 👩‍🚀 and \U0001f680\U0001f680", "tab\tand space", "▁ already", "<s> </s> <unk> <0x41>",
    "a" * 500, "the cat sat on the mat. " * 40, "\x00\x01control", "x", "ﬁne ｆｕｌｌ ① Ⅷ",
]


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.model_path())


def random_texts(n):
    d = random.Random(8)
    pool = "abc ABC  \n\t.,é日👍'ﬁ①０"
    return ["".join(d.choice(pool) for _ in range(d.randint(0, 80))) for _ in range(n)]


def test_ids_are_those_of_the_library(model):
    texts = TEXTS + random_texts(300)
    real = sentencepiece.SentencePieceProcessor(model_proto=model.data)
    ids, _, rows, exact = pieces.Encoder(model).encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[rows[k] : rows[k + 1]].tolist() == real.encode(t), t


def test_spans_cover_the_source(model):
    texts = TEXTS + random_texts(300)
    ids, offsets, rows, exact = pieces.Encoder(model).encode(pa.array(texts))
    for k, t in enumerate(texts):
        raw = t.encode()
        at = offsets[rows[k] + k : rows[k + 1] + k + 1]
        assert (at[0], at[-1]) == (0, len(raw)) and (np.diff(at) >= 0).all()
        for n, i in enumerate(ids[rows[k] : rows[k + 1]]):
            surface = model.bytes[model.start[i] : model.start[i + 1]].tobytes()
            span = raw[at[n] : at[n + 1]].replace(pieces.META, b" ")
            assert span in (surface, surface[1:] if n == 0 and surface[:1] == b" " else surface), (t, n)


def test_round_trip(spark, docs_of, clash):
    texts = [t for t in TEXTS + random_texts(200) if "▁" not in t]
    docs = clash(docs_of([*texts, None]))
    encoded = pieces.encode(docs)
    assert encoded.columns == ["doc_id", "ids", "offsets", "pieces", "exact"]
    back = {r.doc_id: r.text for r in pieces.decode(encoded).collect()}
    assert back == dict(enumerate([*texts, None]))


def test_exact_tells_what_decoding_gives(spark, docs_of):
    texts = ["a mark \u2581 in it", "\u2581", "none in it", " a space first", "", None]
    encoded = pieces.encode(docs_of(texts))
    back = {r.doc_id: r.text for r in pieces.decode(encoded).collect()}
    got = {r.doc_id: r.exact for r in encoded.collect()}
    assert got == {k: back[k] == t for k, t in enumerate(texts)}
    assert [got[k] for k in range(6)] == [False, False, True, True, True, True]


def darts(pairs):
    """A compiled character map of (from, to) pairs: a double array with a block for each trie node."""
    strings, trie = b"", {}
    for source, to in pairs:
        node = trie
        for b in source.encode():
            node = node.setdefault(b, {})
        node["value"] = len(strings)
        strings += to.encode() + b"\0"
    blocks, todo = [trie], [trie]
    while todo:
        node = todo.pop()
        for b, child in node.items():
            if b != "value":
                blocks.append(child)
                todo.append(child)
    base = {id(n): 256 * (k + 1) for k, n in enumerate(blocks)}
    units = [0] * (256 * (len(blocks) + 1))

    def offset(place, to):
        o = place ^ to
        return o << 10 if o < 1 << 21 else o >> 8 << 10 | 512

    units[0] = offset(0, base[id(trie)])
    for node in blocks:
        for b, child in node.items():
            at = base[id(node)] ^ (0 if b == "value" else b)
            units[at] = 1 << 31 | child if b == "value" else b | offset(at, base[id(child)]) | ("value" in child) << 8
    return struct.pack(f"<I{len(units)}I", 4 * len(units), *units) + strings


@pytest.fixture(scope="module")
def mapped(model):
    """The same pieces behind a character map, with white space collapsed."""
    blob = darts([("ﬁ", "fi"), ("①", "1"), ("A", "a"), ("AB", "[ab]"), ("\t", " "), ("０", "0"), (" ", " "), ("é", "é"), ("x", "")])
    spec = pieces.wire(1, b"own") + pieces.wire(2, blob) + pieces.wire(3, 1) + pieces.wire(4, 1) + pieces.wire(5, 1)
    kept = b"".join(pieces.wire(n, v) if isinstance(v, (int, bytes)) else b"" for n, v in pieces.fields(model.data) if n not in (3, 4, 5))
    return pieces.Model(kept + pieces.wire(3, spec))


def test_longest_prefix_map_agrees_with_the_library(mapped):
    texts = [t for t in TEXTS + random_texts(300) + ["ABBA  Axe\t\tﬁn", "xx", "x ", "  "] if "\x00" not in t]
    real = sentencepiece.SentencePieceProcessor(model_proto=mapped.data)
    ids, offsets, rows, _ = pieces.Encoder(mapped).encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[rows[k] : rows[k + 1]].tolist() == real.encode(t), repr(t)
        at = offsets[rows[k] + k : rows[k + 1] + k + 1]
        assert (np.diff(at) >= 0).all() and at[-1] <= len(t.encode())


def remade(model, kinds, blob, trim=1):
    """The same pieces with other kinds for some, behind a character map."""
    spec = pieces.wire(1, b"own") + pieces.wire(2, blob) + pieces.wire(3, 1) + pieces.wire(4, trim) + pieces.wire(5, 1)
    kept = []
    for number, value in pieces.fields(model.data):
        if number == 1 and (piece := dict(pieces.fields(value)))[1] in kinds:
            value = pieces.wire(1, piece[1]) + b"\x15" + piece.get(2, bytes(4)) + pieces.wire(3, kinds[piece[1]])
        if number not in (3, 4, 5):
            kept.append(pieces.wire(number, value))
    return pieces.Model(b"".join(kept) + pieces.wire(3, spec))


def nfkc_pairs():
    """A map like the usual ones: compatibility forms, composed marks, white space, and some characters away."""
    pairs = []
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2200), *range(0x2460, 0x2500), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), *range(0x3300, 0x3358)]:
        c = chr(code)
        composed, split = unicodedata.normalize("NFKC", c), unicodedata.normalize("NFD", c)
        if composed != c:
            pairs.append((c, composed))
        if split != c and unicodedata.normalize("NFC", split) == c:
            pairs.append((split, c))
    spaces = [(c, " ") for c in "\t\n\r\u2000\u2003\u3000"]
    return list({**dict(pairs), **dict(spaces), "\u200b": "", "\x01": "", "\x7f": ""}.items())


def map_texts(n):
    d = random.Random(31)
    pool = [*"abc ABC ef  .,", "\t", "e\u0301", "A\u0300", "é", "①", "ﬁ", "Ｆ", "㌀", "\u200b", "\x01", "\u3000", "日", "👍", "½", "ſ", "ab", "the ", "a\u0300\u0301"]
    return ["".join(d.choice(pool) for _ in range(d.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("trim", [0, 1])
def test_a_map_of_compatibility_forms_agrees_with_the_library(model, trim):
    own = remade(model, {}, darts(nfkc_pairs()), trim)
    real = sentencepiece.SentencePieceProcessor(model_proto=own.data)
    texts = [t for t in TEXTS + random_texts(200) + map_texts(600) if "\x00" not in t]
    ids, offsets, rows, _ = pieces.Encoder(own).encode(pa.array(texts))
    for k, t in enumerate(texts):
        proto = real.encode(t, return_type="proto")
        assert ids[rows[k] : rows[k + 1]].tolist() == [p.id for p in proto.pieces], repr(t)
        assert offsets[rows[k] + k : rows[k + 1] + k].tolist() == [p.begin for p in proto.pieces], repr(t)


def test_user_defined_pieces_are_left_as_they_are(model):
    kinds = {b"A": pieces.USER, b"the": pieces.USER, "é".encode(): pieces.USER}
    pairs = [("A", "a"), ("B", "b"), ("t", "T"), ("é", "e"), (" ", " "), ("\t", " ")]
    own = remade(model, kinds, darts(pairs))
    real = sentencepiece.SentencePieceProcessor(model_proto=own.data)
    texts = ["AB at the theatre", "A A  A", "ébAé\tt", " the", "thethe A"] + [t for t in map_texts(200) if "\x00" not in t]
    ids, _, rows, _ = pieces.Encoder(own).encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[rows[k] : rows[k + 1]].tolist() == real.encode(t), repr(t)


def test_unknown_pieces_cover_their_text(model):
    kept = []
    for number, value in pieces.fields(model.data):
        if number == 1 and (piece := dict(pieces.fields(value))).get(3) == pieces.BYTE:
            value = pieces.wire(1, piece[1]) + pieces.wire(3, 5)  # unused
        if number == 2:
            value = b"".join(pieces.wire(n, v) for n, v in pieces.fields(value) if n != 35 and isinstance(v, (int, bytes)) and n < 10)
        kept.append(pieces.wire(number, value))
    own = pieces.Model(b"".join(kept))
    real = sentencepiece.SentencePieceProcessor(model_proto=own.data)
    texts = ["a 日本 b", "👍👍", "é", "x\ny"]
    ids, offsets, rows, exact = pieces.Encoder(own).encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[rows[k] : rows[k + 1]].tolist() == real.encode(t)
        assert offsets[rows[k + 1] + k] == len(t.encode())
        assert exact[k] == (own.unknown not in ids[rows[k] : rows[k + 1]])


def test_the_query_decodes_what_it_encodes(spark, data):
    import hashlib

    got = pieces.query(spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(got) == len(texts)
    assert all(r.exact == (r.decoded == hashlib.md5(texts[r.doc_id].encode()).hexdigest()) for r in got)
    assert sum(r.exact for r in got) > 0.99 * len(got)


def test_alignment_of_a_replacement(mapped):
    norm, where = pieces.normalise("ﬁ AB①".encode(), mapped)
    assert norm == b" fi [ab]1"
    assert where.tolist() == [0, 0, 0, 3, 4, 4, 4, 4, 6, 9]


def test_odd_rows(spark, docs_of, words):
    long = " ".join(words(60_000, 3))
    rows = [(1, None), (2, ""), (None, "hi"), (3, "hi"), (3, "hi"), (4, long)]
    got = pieces.encode(docs_of(rows)).collect()
    assert len(got) == 6 and all(r.exact for r in got)
    by = {r.doc_id: r for r in got}
    assert (by[1].ids, by[1].offsets, by[1].pieces) == (None, None, 0)
    assert (by[2].ids, by[2].offsets, by[2].pieces) == ([], [0], 0)
    assert by[3].ids == by[None].ids and by[4].offsets[-1] == len(long.encode())
    assert pieces.encode(docs_of(["x"]).where("false")).count() == 0
    wide = pieces.encode(docs_of(rows)).selectExpr("*", "1 as text", "2 as model", "3 as row")
    back = pieces.decode(wide, keep=("pieces",))
    assert back.columns == ["doc_id", "text", "pieces"] and {r.doc_id: r.text for r in back.collect()} == dict(rows)
    assert pieces.decode(wide.where("false")).count() == 0
