"""Token files and byte-pair encoding against the tokenizers library."""

import io
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dyadspark.llm import bpe, token_files
from dyadspark.llm.queries import word_vocabulary
from tests.llm.fixtures import corpus, documents, empty

tokenizers = pytest.importorskip("tokenizers")

ODD = [
    "<|endoftext|>it's <|startoftext|>x<|endoftext|>", "İstanbul ΑΣ ΣΑΣ ß", "日本語123 45.6", "x\x1cy\x85z\xa0w\t\tq", "'sfoo 'll I'LL",
    "é ń a ́b", "abcdefghij" * 60, "\x00\x7f€", "👩‍👩‍👧 ok!!!???", "ﬁ Å", "Word. word, WORD... wor.d, a,b", "ÀÉ. Straße,",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = tokenizers.Tokenizer.from_file(word_vocabulary())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def test_encoding_is_the_library_s(spark, library):
    rows = corpus() + [(1000 + k, t) for k, t in enumerate(ODD)]
    docs = documents(spark, rows).withColumn("n_tokens", F.lit("x"))
    got = bpe.encode(docs, word_vocabulary())
    assert got.columns == [*docs.columns, "_n_tokens", "token_ids", "decoded"]
    for r in got.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == ids
        assert r["_n_tokens"] == len(ids) and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(empty(spark), word_vocabulary()).count() == 0


def test_random_words(library):
    rng, vocabulary = random.Random(3), bpe.Vocabulary(word_vocabulary())
    words = ["".join(rng.choice("aeionrstlcé") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    proposals = [vocabulary.propose(w) for w in map("".join, (vocabulary.pretokens(w) for w in words))]
    stands = vocabulary.check(proposals)
    assert 0.2 < stands.mean() < 1  # both paths are taken
    assert vocabulary.encode_chunks(words) == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


def test_long_word_merges_alike(library):
    word = "abcabcbacbbaca" * 40
    assert bpe.Vocabulary(word_vocabulary()).encode_chunks([word]) == [library.encode(word, add_special_tokens=False).ids]


def test_cache_generations(library):
    vocabulary = bpe.Vocabulary(word_vocabulary())
    texts = [f"alpha{k} beta, gamma. alpha{k - 1}" for k in range(30)]
    for encode, between in ((bpe.piece_encoder(vocabulary), [bpe.NO_BYTES, bpe.BLANK_TEXT]), (token_files.library_encoder(word_vocabulary()), [bpe.NO_BYTES])):
        table = bpe.ChunkTable(encode, between, size=5)
        got = [g for k in range(0, 30, 2) for g in table.joined(pa.array([*texts[k : k + 2], None]))[0].to_pylist()]
        assert got[2::3] == [b""] * 15
        got = [g for k, g in enumerate(got) if k % 3 < 2]
        assert len(table.young[0]) <= 8 and len(table.old[0])
        check_ids(got, texts, library)


def check_ids(got, texts, library):
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_side_by_side_merge_alike(library):
    vocabulary, rng = bpe.Vocabulary(word_vocabulary()), random.Random(9)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 45))) for _ in range(3000)]
    words += ["".join(vocabulary.letters[rng.randrange(256)] for _ in range(5)) for _ in range(50)]
    assert vocabulary.whole
    assert vocabulary.exact_many(words) == [vocabulary.exact(w) for w in words]


@pytest.mark.parametrize("maker", ["own", "library"])
def test_chunks_with_marks(library, maker):
    marks = ["", ".", ",", "###", "&&&", "!?", "'s", "<", "'", "...'", "_", "-", "\u00bf", "1", "\u200b"]
    words = ["", "Word", "word", "\u00c9t\u00e9", "e\u0301te", "Stra\u00dfe", "\u0130x", "\u017fo", "\u0391\u03a3", "\u65e5\u672c", "\u01c5", "a1b", "x.y"]
    texts = [f"{w}{m} {m}{w}" for w in words for m in marks]
    texts = [f" {t}\n{u}  {t}" for t, u in zip(texts, texts[7:] + texts[:7])]
    vocabulary = bpe.Vocabulary(word_vocabulary())
    if maker == "own":
        table = bpe.ChunkTable(bpe.piece_encoder(vocabulary), [bpe.NO_BYTES, bpe.BLANK_TEXT])
        ids, names = table.joined(pa.array(texts))
        assert names.to_pylist() == [library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in texts]
    else:
        (ids,) = bpe.ChunkTable(token_files.library_encoder(word_vocabulary()), [bpe.NO_BYTES]).joined(pa.array(texts))
    check_ids(ids.to_pylist(), texts, library)


@pytest.mark.parametrize("top", [1, 200, 256, 70_000, 2**32 - 1])
def test_file_gives_any_token(top):
    rng = np.random.default_rng(top)
    ids = (rng.random(3000) ** 4 * top).astype(np.uint32)
    sizes = [0, 1, 700, 0, 1299, 1000]
    source = token_files.TokenFile(io.BytesIO(token_files.file_bytes([5, None, 7, 7, 8, 9], sizes, ids)))
    assert (source.documents, source.tokens) == (6, 3000) and source.keys(0, 6) == [5, None, 7, 7, 8, 9]
    assert source.starts(0, 6).tolist() == [0, *np.cumsum(sizes)]
    assert source.ids(0, 3000).tolist() == ids.tolist()
    for _ in range(60):
        a = int(rng.integers(0, 3000))
        assert source.ids(a, a + 1).tolist() == [ids[a]]
        b = int(rng.integers(a, 3001))
        assert source.ids(a, b).tolist() == ids[a:b].tolist()


def test_files_hold_all_documents_in_order(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TOKENS", 500)
    rows = corpus()
    files = token_files.write_tokens(documents(spark, rows), f"file://{tmp_path}/tokens", word_vocabulary(), 2)
    got = token_files.read_tokens(files, step=3).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    assert len(got) == len(want)
    for r, (key, text) in zip(got, want):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (key, start, len(ids))
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == ids
        start += len(ids)
    assert not list(tmp_path.glob("**/*.tmp"))


def test_files_of_no_documents(spark, tmp_path):
    files = token_files.write_tokens(empty(spark), f"file://{tmp_path}/none", word_vocabulary(), 2)
    assert token_files.read_tokens(files).collect() == []
