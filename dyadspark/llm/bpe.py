"""Byte-pair encoding by speculation: longest matches are proposed, pairs are checked, failing words are merged exactly.

The vocabulary file of a public tokenizer is read by the workers; nothing is trained. White space separates words in
this kind of vocabulary (lower case, word ends), so a text is the sequence of its blank-separated chunks, each chunk is
encoded once per worker and kept in a bounded cache, and the ids of a text are the joined ids of its chunks.

A proposal is right if each pair of neighbours, encoded alone, gives just that pair: a merge across a border would
happen in the pair as well. Pairs are remembered, so nearly all checks are one vectorised look-up.

Empty texts give no ids; null texts count as empty; texts are encoded whole whatever their length; rows may repeat.
"""

from __future__ import annotations

import heapq
import json
import re
import string
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadspark.llm.common import free_name, packed_words, small_batches, text_bytes, word_bounds, worker_cache

END = "</w>"
CACHED = 200_000  # chunks in the younger half of a worker's cache
LONG = 40  # letters; longer words are merged one by one
SPACES = np.isin(np.arange(256), [32, 10])
MARKS = "".join(c for c in string.punctuation if c not in "'<")  # with the apostrophe shortened forms begin, with < special tokens


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks, normal form and pre-tokens of one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): k for k, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.longest = max(len(s.removesuffix(END)) for s in self.ids)
        self.letters = byte_letters()
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        known = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in self.rank if a in self.ids and b in self.ids and a + b in self.ids]
        self.whole = len(known) == len(merges)  # merging by numbers needs a number for every part
        codes = np.array([a << 20 | b for a, b, _ in known], np.int64)
        self.by_code = np.argsort(codes)
        self.codes, self.merged = codes[self.by_code], np.array([c for *_, c in known], np.int64)
        self.letter_ids = np.array([[self.ids.get(chr(k) + end, -1) for k in range(512)] for end in ("", END)])
        self.fits: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}

    # -- text to words ---------------------------------------------------------------------------------------------

    def lower(self, text: str) -> str:
        """Lower case letter by letter (Python lowers a final sigma by its place in the word)."""
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def pretokens(self, chunk: str) -> list[str | int]:
        """Words in byte letters; special tokens of the raw text come as their ids."""
        out: list[str | int] = []
        at = 0
        for m in self.cut.finditer(chunk) if "<" in chunk else ():
            out += self._plain(chunk[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._plain(chunk[at:] if at else chunk)

    def _plain(self, text: str) -> list[str]:
        found = self.words.findall(self.lower(unicodedata.normalize("NFC", text)))
        return list(map(self.spelled, found))

    def spelled(self, word: str) -> str:
        """A word in byte letters."""
        return word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])

    # -- words to ids ----------------------------------------------------------------------------------------------

    def propose(self, word: str) -> list[int]:
        """Greedy longest matches from the left; the last one carries the word end."""
        ids, out, i, n = self.ids, [], 0, len(word)
        while i < n:
            if n - i <= self.longest and (found := ids.get(word[i:] + END)) is not None:
                out.append(found)
                break
            for j in range(min(n - 1, i + self.longest), i, -1):
                if (found := ids.get(word[i:j])) is not None:
                    out.append(found)
                    i = j
                    break
            else:
                i += 1  # a letter the vocabulary lacks gives no token, as in the library
        return out

    def symbols(self, word: str) -> list[str]:
        return [*word[:-1], word[-1] + END]

    def merge(self, parts: list[str]) -> list[int]:
        """Exact merging: always the leftmost pair of lowest rank."""
        get, none = self.rank.get, 1 << 30
        if len(parts) <= 100:
            order = [get(p, none) for p in zip(parts, parts[1:])]
            while order and (least := min(order)) < none:
                k = order.index(least)
                parts[k] += parts.pop(k + 1)
                del order[k]
                if k:
                    order[k - 1] = get((parts[k - 1], parts[k]), none)
                if k < len(order):
                    order[k] = get((parts[k], parts[k + 1]), none)
        else:
            parts = self._merge_long(parts)
        return [self.ids[p] for p in parts if p in self.ids]

    def _merge_long(self, parts: list[str]) -> list[str]:
        rank, n = self.rank, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := rank.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        live: list[str | None] = list(parts)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if live[k] != a or j >= n or live[j] != b:
                continue
            live[k], live[j] = a + b, None
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (r := rank.get((live[left], live[after[left]]))) is not None:
                    heapq.heappush(heap, (r, left, live[left], live[after[left]]))
        return [p for p in live if p is not None]

    def exact(self, word: str) -> list[int]:
        return self.merge(self.symbols(word))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or a number beyond all ranks."""
        code = left << 20 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.by_code[at], len(self.codes))

    def exact_many(self, words: list[str]) -> list[list[int]]:
        """``exact`` for many words at once: words of one length are merged side by side, one pair of each per round."""
        out: list[list[int]] = [[]] * len(words)
        lengths: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            lengths.setdefault(len(w), []).append(k)
        for n, rows in lengths.items():
            if n < 2 or n > LONG or len(rows) < 8 or not self.whole:
                for k in rows:
                    out[k] = self.exact(words[k])
                continue
            letters = np.frombuffer("".join([words[k] for k in rows]).encode("utf-32-le"), np.uint32).reshape(-1, n)
            ids = np.concatenate([self.letter_ids[0][letters[:, :-1]], self.letter_ids[1][letters[:, -1:]]], axis=1)
            if (ids < 0).any():
                for k in rows:
                    out[k] = self.exact(words[k])
                continue
            places, none = np.array(rows), len(self.codes)
            rank = self.ranks(ids[:, :-1], ids[:, 1:])
            while len(places):
                at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(places), np.int64)
                least = rank[np.arange(len(places)), at] if rank.shape[1] else np.full(len(places), none)
                for k, done in zip(places[least == none].tolist(), ids[least == none].tolist()):
                    out[k] = done
                on = least < none
                places, ids, rank, at, least = places[on], ids[on], rank[on], at[on], least[on]
                row, column = np.arange(len(places)), np.arange(ids.shape[1] - 1)
                ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
                ids[row, at] = self.merged[least]
                rank = np.take_along_axis(rank, column[:-1] + (column[:-1] >= at[:, None]), 1)
                left, right = row[at > 0], row[at < ids.shape[1] - 1]
                rank[left, at[left] - 1] = self.ranks(ids[left, at[left] - 1], ids[left, at[left]])
                rank[right, at[right]] = self.ranks(ids[right, at[right]], ids[right, at[right] + 1])
        return out

    def _split_name(self, *ids: int) -> list[str]:
        text = "".join(self.names[i] for i in ids)
        return self.symbols(text.removesuffix(END)) if text.endswith(END) else list(text)

    def check(self, proposals: list[list[int]]) -> np.ndarray:
        """Whether each proposal stands: every pair of neighbours (or the single token) encodes to itself."""
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((i for p in proposals for i in p), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        good = np.ones(len(proposals), bool)
        single = np.flatnonzero(sizes == 1)
        for k in single:
            token = int(flat[ends[k] - 1])
            if token not in self.alone:
                self.alone[token] = self.merge(self._split_name(token)) == [token]
            good[k] = self.alone[token]
        inner = np.ones(len(flat), bool)
        inner[ends[sizes > 0] - 1] = False
        left = np.flatnonzero(inner)
        codes = flat[left] << 20 | flat[left + 1] if len(left) else np.zeros(0, np.int64)
        distinct, back = np.unique(codes, return_inverse=True)
        fits = np.empty(len(distinct), bool)
        for k, code in enumerate(distinct.tolist()):
            a, b = code >> 20, code & 0xFFFFF
            known = self.fits.get((a, b))
            if known is None:
                if len(self.fits) > 300_000:
                    self.fits.clear()
                known = self.fits[a, b] = self.merge(self._split_name(a, b)) == [a, b]
            fits[k] = known
        owner = np.repeat(np.arange(len(proposals)), sizes)
        good[owner[left[~fits[back]]]] = False
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words in byte letters: proposals in bulk, exact merging only for those that fail the pair checks."""
        proposals = [self.propose(w) for w in words]
        failed = np.flatnonzero(~self.check(proposals)).tolist()
        for k, ids in zip(failed, self.exact_many([words[k] for k in failed])):
            proposals[k] = ids
        return proposals

    def encode_chunks(self, chunks: list[str], plain: np.ndarray | None = None) -> list[list[int]]:
        """Ids of chunks; ``plain`` ones are one lower-case word or run of marks (or empty) and need no splitting."""
        if plain is None:
            plain = np.zeros(len(chunks), bool)
        pieces = [([self.spelled(c)] if c else []) if p else self.pretokens(c) for c, p in zip(chunks, plain.tolist())]
        words = list({p for ps in pieces for p in ps if isinstance(p, str)})
        known = dict(zip(words, self.encode_words(words)))
        return [[i for p in ps for i in (known[p] if isinstance(p, str) else (p,))] for ps in pieces]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' names with blanks between them: what a vocabulary without a decoder gives."""
        return " ".join(self.names[i] for i in ids)


def plain_word(chunk: str) -> str | None:
    """The lower-case word of a chunk that is letters only, but for one full stop or comma at its end; else None.

    Such a chunk has the word's tokens and then the mark's. Words that are not in composed form are left alone.
    """
    core = chunk[:-1] if chunk[-1:] in (".", ",") else chunk
    if not core.isalpha():
        return None
    low = core.lower()
    if core.isascii():
        return low
    composed = unicodedata.is_normalized
    return low if "Σ" not in core and composed("NFC", core) and composed("NFC", low) and low.isalpha() else None


class ChunkCache:
    """Ids (and names) of chunks in two generations; the older one goes when the younger is full."""

    def __init__(self, encode, join, size: int = CACHED, simple: bool = True):
        """``simple``: a word's entry does not depend on its case, and a mark after it adds its own entry (``join``)."""
        self.encode, self.join, self.size, self.young, self.old = encode, join, size, {}, {}
        self.plain = plain_word if simple else lambda chunk: None

    def fill(self, chunks: set[str]) -> None:
        """Make sure that ``young`` knows all of ``chunks``."""
        missing = chunks - self.young.keys()
        if len(self.young) + len(missing) > self.size and self.young:
            self.old, self.young = self.young, {}
            missing = chunks
        young, old, new, built = self.young, self.old, set(), []
        for c in missing:
            if (found := old.get(c)) is not None:
                young[c] = found
            elif (core := self.plain(c)) is None or core == c:
                new.add(c)
            else:
                tail = c[-1] if c[-1] in ".," else ""
                built.append((c, core, tail))
                for part in (core, tail):
                    if part and part not in young:
                        if (found := old.get(part)) is not None:
                            young[part] = found
                        else:
                            new.add(part)
        if new:
            young.update(zip(new, self.encode(list(new))))
        for c, core, tail in built:
            young[c] = self.join(young[core], young[tail]) if tail else young[core]

    def lines(self, texts: list[str]) -> Iterator[list]:
        """The cached entries of each text's chunks, in order."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        self.fill(set().union(*split))
        get = self.young.__getitem__
        for chunks in split:
            yield list(map(get, chunks))


def latin_word(chunk: str) -> tuple[str, str] | None:
    """A chunk of Latin letters with ASCII marks behind them, as (lower-case word, marks); None for other chunks.

    Letters beyond U+024F and chunks that are not in composed form count as other chunks.
    """
    core = chunk.rstrip(MARKS)
    low = core.lower()
    if not core or max(core) > "\u024f" or not core.isalpha() or len(low) != len(core) or not unicodedata.is_normalized("NFC", low):
        return None
    return low, chunk[len(core) :]


def words_and_marks(chunks: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Each chunk as word and marks (either may be empty), and which chunks have this form; others stay whole.

    Word and marks are pre-tokens of their own, so a chunk's tokens are those of the one and then those of the other.
    """
    ascii = pc.match_substring_regex(chunks, f"^[A-Za-z]*[{re.escape(MARKS)}]*$")
    words = pc.if_else(ascii, pc.ascii_lower(pc.ascii_rtrim(chunks, characters=MARKS)), chunks)
    marks = pc.if_else(ascii, pc.replace_substring_regex(chunks, "^[A-Za-z]+", "", max_replacements=1), "")
    formed = ascii.to_numpy(zero_copy_only=False).copy()
    others = np.flatnonzero(~formed)
    parts = [latin_word(c) for c in chunks.take(pa.array(others)).to_pylist()]
    known = np.array([p is not None for p in parts], bool)
    if known.any():
        formed[others[known]] = True
        mask = np.zeros(len(chunks), bool)
        mask[others[known]] = True
        mask = pa.array(mask)
        words = pc.replace_with_mask(words, mask, pa.array([p[0] for p in parts if p], words.type))
        marks = pc.replace_with_mask(marks, mask, pa.array([p[1] for p in parts if p], marks.type))
    return words, marks, formed


class ChunkTable:
    """Encoded chunks as Arrow arrays, in two generations; the older one goes when the younger is full.

    ``encode`` gets pieces (see ``words_and_marks``; other chunks are pieces as they are) and whether each one is a word or
    a run of marks, and gives one array per column; ``between`` has what joins the entries of each column. Chunks are
    told apart and looked up by Arrow; only chunks that neither generation knows are touched one by one.
    """

    def __init__(self, encode, between: list, size: int = CACHED):
        self.encode, self.between, self.size = encode, between, size
        self.young: list[pa.Array] = []
        self.old: list[pa.Array] = []

    def _known(self, chunks: pa.Array, held: list[pa.Array]) -> pa.Array:
        return pc.index_in(chunks, held[0]) if held else pa.nulls(len(chunks), pa.int32())

    def _made(self, chunks: pa.Array) -> list[pa.Array]:
        """Entries of new chunks: those of their pieces, joined."""
        words, marks, formed = words_and_marks(chunks)
        n = len(chunks)
        pieces = pa.concat_arrays([words.cast(pa.large_string()), marks.cast(pa.large_string())]).dictionary_encode()
        codes = pieces.indices.to_numpy()
        plain = np.ones(len(pieces.dictionary), bool)
        plain[codes[:n][~formed]] = False
        turns = np.stack([codes[:n], codes[n:]], axis=1).ravel()  # word, marks, word, marks, ...
        return self._joined(self.encode(pieces.dictionary.to_pylist(), plain), pa.array(turns), np.arange(0, 2 * n + 1, 2))

    def _joined(self, columns: list[pa.Array], codes: pa.Array, bounds: np.ndarray) -> list[pa.Array]:
        """Entries joined by stretches of ``codes``; entries without ids (the first column) are left out."""
        filled = pc.greater(pc.binary_length(columns[0]), 0)
        if not pc.all(filled).as_py():
            kept = filled.take(codes).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
            codes = codes.filter(pa.array(kept))
        bounds = pa.array(bounds, pa.int64())
        return [pc.binary_join(pa.LargeListArray.from_arrays(bounds, c.take(codes)), b) for c, b in zip(columns, self.between)]

    def _entries(self, chunks: pa.Array) -> list[pa.Array]:
        missing = pc.is_null(self._known(chunks, self.young))
        if self.young and len(self.young[0]) + pc.sum(missing).as_py() > self.size:
            self.old, self.young, missing = self.young, [], pa.array(np.ones(len(chunks), bool))
        lacking = chunks.filter(missing)
        if len(lacking):
            at = self._known(lacking, self.old)
            parts = [[lacking.filter(pc.is_valid(at)), *[c.take(at.drop_null()) for c in self.old[1:]]]] if self.old else []
            new = lacking.filter(pc.is_null(at))
            if len(new):
                parts.append([new, *self._made(new)])
            parts = ([self.young] if self.young else []) + parts
            self.young = [pa.concat_arrays(list(c)) for c in zip(*parts)]
        at = self._known(chunks, self.young)
        return [c.take(at) for c in self.young[1:]]

    def joined(self, texts: pa.Array) -> list[pa.Array]:
        """The entries of each text's chunks, joined, column by column; a null text counts as empty."""
        data, bounds = text_bytes(texts)
        starts, ends, first = word_bounds(data, bounds, SPACES)
        chunks = packed_words(data, starts, ends, SPACES).dictionary_encode()
        if not len(starts):
            empty = pa.array([0] * (len(texts) + 1), pa.int64())
            return [pc.binary_join(pa.LargeListArray.from_arrays(empty, pa.array([], b.type)), b) for b in self.between]
        return self._joined(self._entries(chunks.dictionary), chunks.indices, first)


NO_BYTES, NO_TEXT, BLANK_TEXT = pa.scalar(b"", pa.large_binary()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())


def piece_encoder(vocabulary: Vocabulary):
    """Pieces to ids (little-endian 32-bit numbers) and names joined by blanks."""

    def encode(pieces: list[str], plain: np.ndarray) -> list[pa.Array]:
        ids = vocabulary.encode_chunks(pieces, plain)
        names = [vocabulary.decode(i) for i in ids]
        return [pa.array([np.asarray(i, "<u4").tobytes() for i in ids], pa.large_binary()), pa.array(names, pa.large_string())]

    return encode


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of ``df`` and ``n_tokens`` long, ``token_ids`` binary (little-endian unsigned 32-bit), ``decoded`` string.

    ``path`` is a vocabulary file all workers can read. New columns whose name is taken get leading underscores.
    """
    names = [free_name(df, c) for c in ("n_tokens", "token_ids", "decoded")]
    schema = T.StructType([*df.schema.fields, *map(T.StructField, names, (T.LongType(), T.BinaryType(), T.StringType()))])
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = worker_cache(f"bpe:{path}", lambda: ChunkTable(piece_encoder(Vocabulary(path)), [NO_BYTES, BLANK_TEXT], size=400_000))
        for batch in small_batches(batches, text):
            ids, decoded = table.joined(batch.column(place))
            sizes = pc.divide(pc.cast(pc.binary_length(ids), pa.int64()), 4)
            new = [sizes, ids.cast(pa.binary()), decoded.cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, number of tokens and digests of ids and decoded text."""
    return encoded.select(
        key,
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
