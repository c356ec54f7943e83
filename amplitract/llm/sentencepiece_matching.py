"""SentencePiece encoding and decoding by suffix-array matching.

The text of a batch is cut at word starts (no piece runs over one) and each distinct word is indexed once: the words
are concatenated, their suffixes sorted, and every piece of the vocabulary is looked up by binary search, which gives
the range of suffixes that begin with it, so all of its occurrences. The occurrences are edges from a start to an end
position; sorted by position they are the lattice that is then relaxed, all words at a time.

For a BPE model the relaxation isn't a shortest path, whose result differs from SentencePiece's: in each step every
word contracts the edge of best rank (leftmost if equal) among those that join two neighbouring symbols, until none is
left. That gives the ids of the SentencePiece library, which the tests hold it against. Characters without a piece
become byte pieces. All words are indexed, whatever their length: texts without spaces are cut first between characters
that no piece holds side by side, which no contraction crosses. The lattice of a word that is longer than LONG still is
contracted by a heap of its edges instead of in steps of all words, so that no text costs more than n log n.

Defined cases: a null text encodes to null and an empty one to an empty list; a U+2581 in a text decodes to a space, as in the library; no text is normalised; a model that
isn't BPE, or whose normaliser isn't the identity, is refused; decoding replaces malformed byte runs by U+FFFD and leaves control pieces out.
Extra columns pass through; columns with the names of results are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shared import freeing, others, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONG = 48
#: What separates words in the index: it sorts below all characters and is in no piece.
END = 0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) of the fields of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return value

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
        yield key >> 3, data[i : i + size]
        i += size


def _checked(model: bytes) -> None:
    """Refuses models that aren't BPE or that change texts before they are cut into pieces."""
    parts = dict(x for x in _fields(model) if x[0] in (2, 3))
    trainer, normaliser = dict(_fields(parts.get(2, b""))), dict(_fields(parts.get(3, b"")))
    if trainer.get(3, 1) != 2:
        raise ValueError("the model must be a BPE model")
    if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1):
        raise ValueError("the model's normaliser must be the identity, with a space put before the text")


class Pieces:
    """A BPE vocabulary with byte fallback."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        _checked(model)
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.vocab_size()
        self.text = [lib.id_to_piece(i) for i in range(n)]
        self.byte = np.full(256, -1, np.int32)
        self.control = np.array([lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(n)])
        normal = []
        for i, piece in enumerate(self.text):
            if lib.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not self.control[i]:
                normal.append(i)
        if (self.byte < 0).any() or any(SPACE in p.lstrip(SPACE) for p in map(self.text.__getitem__, normal)):
            raise ValueError("the model must have byte pieces, and no piece with a space inside")
        # rank 0 is merged first: by score, then by id
        self.rank = np.full(n, np.iinfo(np.int32).max, np.int32)
        self.rank[sorted(normal, key=lambda i: (-lib.get_score(i), i))] = np.arange(len(normal), dtype=np.int32)
        score = {}
        for i in normal:  # equal scores share a rank: then the leftmost goes first
            self.rank[i] = score.setdefault(lib.get_score(i), self.rank[i])
        self.single = {self.text[i]: i for i in normal if len(self.text[i]) == 1}
        self.longer = sorted((self.text[i], i) for i in normal if len(self.text[i]) > 1)
        self.longest = max(len(p) for p, _ in self.longer)
        codes = np.zeros((len(self.longer), self.longest), np.uint32)
        for k, (p, _) in enumerate(self.longer):
            codes[k, : len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
        self.codes, self.lengths = codes, np.array([len(p) for p, _ in self.longer])
        self.ids = np.array([i for _, i in self.longer], np.int32)
        beside = [codes[self.lengths > k + 1, k].astype(np.uint64) << np.uint64(32) | codes[self.lengths > k + 1, k + 1] for k in range(self.longest - 1)]
        #: the pairs of neighbouring characters of all pieces
        self.pairs = np.unique(np.concatenate(beside))
        # line ends and other characters without a piece never merge, so a word may be cut beside them
        alone = "".join(c for c in "\n\t\r" if c not in self.single and not any(c in p for p, _ in self.longer))
        self.words = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """The positions of codes, sorted by the depth characters that follow, by doubling of ranks. The first keys hold as
    many characters as fit into 63 bits."""
    used = np.flatnonzero(np.bincount(codes))
    dense = np.zeros(int(used[-1]) + 1, np.int64)
    dense[used] = np.arange(1, len(used) + 1)
    bits = int(len(used)).bit_length()
    k = max(1, min(63 // bits, depth))
    padded = np.concatenate([dense[codes], np.zeros(k, np.int64)])
    key = np.zeros(len(codes), np.int64)
    for j in range(k):
        key = key << bits | padded[j : j + len(codes)]
    while True:
        order = np.argsort(key)
        if k >= depth:
            return order
        key = key[order]
        rank = np.empty(len(codes), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        second = np.zeros_like(rank)
        second[:-k] = rank[k:] + 1
        key = rank * (len(codes) + 1) + second
        k *= 2


def piece_edges(codes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, id) of each occurrence of a piece of two characters or more, sorted by position."""
    order = suffix_order(codes, pieces.longest)
    lo, hi = np.zeros(len(pieces.ids), np.int64), np.full(len(pieces.ids), len(codes), np.int64)
    padded = np.concatenate([codes, np.zeros(pieces.longest, codes.dtype)])
    for depth in range(pieces.longest):  # narrow every piece's range by one more character, both ends by bisection
        live = np.flatnonzero((pieces.lengths > depth) & (lo < hi))
        if not len(live):
            break
        want = pieces.codes[live, depth]
        ends = []
        for strict in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                at = padded[order[np.minimum(mid, len(order) - 1)] + depth]
                right = ((at <= want) if strict else (at < want)) & open_
                a, b = np.where(right, mid + 1, a), np.where(right | ~open_, b, mid)
            ends.append(a)
        lo[live], hi[live] = ends
    found = np.where(hi > lo, hi - lo, 0)
    piece = np.repeat(np.arange(len(found)), found)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(found) - found, found)
    start = order[lo[piece] + inside]
    length = pieces.lengths[piece]
    by = np.argsort(start * (pieces.longest + 1) + length)
    return start[by], length[by], pieces.ids[piece][by]


def relax(codes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contracts the lattice of END-separated words: (start, end, id) of the symbols left; id -1 has no piece."""
    start, length, ids = piece_edges(codes, pieces)
    width = pieces.longest + 1
    keys = start * width + length
    none = np.iinfo(np.int64).max

    def edge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The index of the edge from a to b, or -1."""
        want = np.where(b - a < width, a * width + (b - a), -1)
        i = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
        return np.where(keys[i] == want, i, -1) if len(keys) else np.full(len(a), -1)

    word = np.cumsum(codes == END)
    begin = np.flatnonzero(codes != END)
    end = begin + 1
    done: list[tuple[np.ndarray, np.ndarray]] = []
    sizes = np.bincount(word[begin], minlength=1) if len(begin) else np.zeros(1, np.int64)
    if (sizes > LONG).any():
        long = sizes[word[begin]] > LONG
        rank_of = dict(enumerate(pieces.rank.tolist()))
        for w in np.flatnonzero(sizes > LONG):
            a = int(begin[np.searchsorted(word[begin], w)])
            lo, hi = np.searchsorted(start, [a, a + sizes[w]])
            of = {(x, x + y): z for x, y, z in zip(start[lo:hi].tolist(), length[lo:hi].tolist(), ids[lo:hi].tolist(), strict=True)}
            symbols = np.array(_contract_long(a, a + int(sizes[w]), of, rank_of))
            done.append((symbols[:, 0], symbols[:, 1]))
        begin, end = begin[~long], end[~long]
    while len(begin):
        joined = edge(begin[:-1], end[1:])
        joined[word[begin[:-1]] != word[begin[1:]]] = -1
        rank = np.full(len(begin), none, np.int64)
        rank[np.flatnonzero(joined >= 0)] = pieces.rank[ids[joined[joined >= 0]]]
        first = np.flatnonzero(np.concatenate([[True], word[begin[1:]] != word[begin[:-1]]]))
        best = np.minimum.reduceat(rank, first)
        counts = np.diff(np.append(first, len(begin)))
        active = np.repeat(best < none, counts)
        done.append((begin[~active], end[~active]))
        begin, end, rank = begin[active], end[active], rank[active]
        if not len(begin):
            break
        hit = np.flatnonzero(rank == np.repeat(best[best < none], counts[best < none]))
        owner = word[begin[hit]]
        hit = hit[np.concatenate([[True], owner[1:] != owner[:-1]])]  # the leftmost of each word
        end[hit] = end[hit + 1]
        keep = np.ones(len(begin), bool)
        keep[hit + 1] = False
        begin, end = begin[keep], end[keep]
    begin = np.concatenate([d[0] for d in done]) if done else begin
    end = np.concatenate([d[1] for d in done]) if done else end
    order = np.argsort(begin)
    begin, end = begin[order], end[order]
    at = edge(begin, end)
    found = np.where(at >= 0, ids[at] if len(ids) else -1, -1).astype(np.int32)
    return begin, end, found


def _contract_long(begin: int, end: int, edges: dict[tuple[int, int], int], rank: dict[int, int]) -> list[tuple[int, int]]:
    """(start, end) of the symbols of one long word, by a heap of the edges that join two neighbours. edges has the id of each
    edge of the lattice by its ends."""
    n = end - begin
    right, left, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and (piece := edges.get((begin + i, begin + j + size[j]))) is not None:
            heapq.heappush(heap, (rank[piece], i, size[i] + size[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, total = heapq.heappop(heap)
        if not size[i] or right[i] >= n or size[i] + size[right[i]] != total:
            continue
        j = right[i]
        size[i], size[j] = total, 0
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out, i = [], 0
    while i < n:
        out.append((begin + i, begin + i + size[i]))
        i = right[i]
    return out


def cut_word(word: str, pieces: Pieces) -> list[str]:
    """A long word in parts, cut between characters that stand side by side in no piece."""
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    pair = codes[:-1] << np.uint64(32) | codes[1:]
    at = np.minimum(np.searchsorted(pieces.pairs, pair), len(pieces.pairs) - 1)
    cuts = [0, *(np.flatnonzero(pieces.pairs[at] != pair) + 1).tolist(), len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def encode_words(words: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one after another, and how many each has."""
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    # codes move up by one, as a word may hold U+0000 and END stands between words
    codes = np.frombuffer("\x00".join(words).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(lengths + 1) - lengths - 1
    codes[begins[1:] - 1] = END
    begin, _, ids = relax(codes, _shift(pieces))
    alone = np.flatnonzero(ids < 0)
    ids[alone] = _singles(pieces)[codes[begin[alone]] - 1]
    sizes = np.ones(len(ids), np.int64)
    alone = alone[ids[alone] < 0]  # characters without a piece
    values = [_character(int(c), pieces) for c in codes[begin[alone]] - 1]
    sizes[alone] = [len(v) for v in values]
    flat = np.repeat(ids, sizes)
    if values:
        flat[flat < 0] = np.concatenate(values)
    return flat, np.add.reduceat(sizes, np.searchsorted(begin, begins))


def _character(code: int, pieces: Pieces) -> list[int]:
    found = pieces.single.get(chr(code))
    return [found] if found is not None else [int(pieces.byte[b]) for b in chr(code).encode("utf-8", "surrogatepass")]


@lru_cache(2)
def _singles(pieces: Pieces) -> np.ndarray:
    """The id of the piece of each single character, or -1."""
    out = np.full(0x110000, -1, np.int32)
    for c, i in pieces.single.items():
        out[ord(c)] = i
    return out


@lru_cache(2)
def _shift(pieces: Pieces) -> Pieces:
    """The same vocabulary over codes moved up by one, as 0 is END."""
    other = object.__new__(Pieces)
    other.__dict__ = pieces.__dict__ | {"codes": np.where(np.arange(pieces.longest) < pieces.lengths[:, None], pieces.codes + 1, 0).astype(np.uint32)}
    return other


class _Numbers(dict):
    """Numbers words in the order they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Coder:
    """Encodes batches of texts. Each distinct word of a batch is indexed and relaxed once; the ids of up to KNOWN
    words are remembered for the next batches, then forgotten all at once, so that memory is bounded."""

    KNOWN = 200_000

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.numbers, self.flat, self.sizes = _Numbers(), np.empty(0, np.int32), np.empty(0, np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        if len(self.numbers) > self.KNOWN:
            self.forget()
        number, find = self.numbers.__getitem__, self.pieces.words.findall

        def words(text: str) -> Iterator[str]:
            for w in find(SPACE + text.replace(" ", SPACE)):
                if len(w) > LONG:
                    yield from cut_word(w, self.pieces)
                else:
                    yield w

        parts = [np.array(list(map(number, words(t))), np.int64) if t else np.empty(0, np.int64) for t in texts]
        if len(self.numbers) > len(self.sizes):
            new = list(islice(self.numbers, len(self.sizes), None))
            flat, sizes = encode_words(new, self.pieces)
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        starts = np.cumsum(self.sizes) - self.sizes
        every = np.concatenate(parts)
        n = self.sizes[every]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(starts[every] - ends + n, n) + np.arange(n.sum())]
        cuts = np.concatenate([[0], ends])[np.cumsum([len(p) for p in parts])]
        return [None if t is None else ids[a:b] for t, a, b in zip(texts, np.concatenate([[0], cuts[:-1]]), cuts, strict=True)]


def encode_batch(texts: list[str | None], pieces: Pieces) -> list[np.ndarray | None]:
    """The ids of each text."""
    return Coder(pieces).encode(texts)


def decode_ids(ids: np.ndarray, pieces: Pieces) -> str:
    """The text of ids: runs of byte pieces are read as UTF-8, the first space goes."""
    raw = b"".join(_bytes_of(pieces)[i] for i in ids)
    text = raw.decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def _bytes_of(pieces: Pieces) -> list[bytes]:
    out = [b"" if c else p.encode() for p, c in zip(pieces.text, pieces.control, strict=True)]
    for value, i in enumerate(pieces.byte):
        out[i] = bytes([value])
    return out


_loaded: dict[str, Coder] = {}


class _Model:
    """A model's bytes, broadcast; each worker builds its coder once, whatever the file's name."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        with open(path, "rb") as f:
            content = f.read()
        _checked(content)
        self.key, self.content = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)

    def coder(self) -> Coder:
        if self.key not in _loaded:
            _loaded.clear()
            _loaded[self.key] = Coder(Pieces(self.content.value))
        return _loaded[self.key]


def _batches(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about so many characters, with the number of the first."""
    part, size, first = [], 0, 0
    for i, t in enumerate(column):
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size >= most:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def encode(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """docs with ids (array<int>), the SentencePiece ids of each whole text."""
    shared = _Model(docs.sparkSession, model)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in _batches(b.column(b.num_columns - 1)):
                ids = pa.array(shared.coder().encode(texts), pa.list_(pa.int32()))
                part = b.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*part.schema.names[:-1], "ids"])

    mine = docs.select(*others(docs, "ids", "_text"), docs[text].alias("_text"))
    return mine.mapInArrow(freeing(encoded), mine.drop("_text").schema.add("ids", T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """df with decoded (string), the text of each row's ids."""
    shared = _Model(df.sparkSession, model)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x.as_py() is None else decode_ids(x.values.to_numpy(), shared.coder().pieces) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "decoded"])

    mine = df.select(*others(df, "decoded", "_ids"), df[ids].alias("_ids"))
    return mine.mapInArrow(freeing(decoded), mine.drop("_ids").schema.add("decoded", "string"))


def token_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """key, n_tokens (long), ids_sha256 (of the ids as little-endian 32-bit numbers; both null for a null text) and
    round_trip (the ids decode to the text)."""
    shared = _Model(docs.sparkSession, model)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in _batches(b.column(1)):
                ids = shared.coder().encode(texts)
                n = pa.array([None if x is None else len(x) for x in ids], pa.int64())
                sha = pa.array([None if x is None else hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string())
                same = pa.array([None if x is None else decode_ids(x, shared.coder().pieces) == t for x, t in zip(ids, texts, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), n, sha, same], names=[key, "n_tokens", "ids_sha256", "round_trip"])

    schema = docs.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("round_trip", "boolean")
    return docs.select(docs[key], docs[text].alias("_text")).mapInArrow(freeing(digested), schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
