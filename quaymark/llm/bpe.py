"""BPE encoding and decoding of texts, exactly as a word-end BPE vocabulary defines it.

Method: a word's symbols are matched against all tokens at once (Aho-Corasick automaton, longest first);
a token is taken only if it is compatible with the one before it, which a table of pairs answers, else the
encoder backs up. Every position is left at most once, so time is linear in the word, and the result is
that of applying the merges in order. Decoding looks tokens up in one byte string by an offset table.

Cases: null and empty texts, and texts of white space, have no tokens and decode to the empty string. Repeated
rows each give a row. Texts of any length are encoded whole, chunk by chunk. An empty table gives an empty
result; columns other than the id and the text are not looked at. An output column that would have the id's name gets an
underscore.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm.common import outputs, read, sliced, small_batches

#: Fixed values of the vocabulary's format: its byte alphabet keeps the printable Latin-1 bytes and moves the others up from 256.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: str.split() also splits at these, which the vocabulary counts as text.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Chunks kept per Python worker: at this many they become the old ones, of which those that come up again are taken over and the rest goes at the next turn.
CACHE_CHUNKS = 300_000
#: Symbols that the automaton is given at once; at their end, where a token may be cut, it begins anew.
SPAN = 1024
#: Chunks longer than this are not kept.
CACHE_CHARS = 64


def vocabulary(path: str | None = None) -> str:
    """The JSON text of a vocabulary file; by default the public 49k word-end vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class Cache(dict):
    """Encodings of chunks; a chunk that isn't there is encoded and kept."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            got = self.encode(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.old = dict(self)
                self.clear()
            self[chunk] = got
        return got


class Codec:
    """Tables of one vocabulary. A symbol is a byte, or a byte at a word's end (256 higher)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not self.suffix:
            raise ValueError("a BPE vocabulary with a word-end suffix is asked for")
        byte_of = {chr(b): b for b in _PLAIN}
        rest = [b for b in range(256) if b not in set(_PLAIN)]
        byte_of |= {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

        def symbols(token: str) -> str:
            end = token.endswith(self.suffix)
            chars = [byte_of[c] for c in (token[: -len(self.suffix)] if end else token)]
            if end:
                chars[-1] += 256
            return "".join(map(chr, chars))

        self.pairs: dict[tuple[int, int], int] = {}
        n = max(vocab.values()) + 1
        self.left, self.right = list(range(n)), list(range(n))
        # The order of the merges decides; the ids of this format follow it, which the tables rely on.
        last = -1
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            i, j, made = vocab[a], vocab[b], vocab[a + b]
            if made <= last or made <= max(i, j):
                raise ValueError("token ids do not follow the merges")
            last = made
            self.pairs[i, j] = made
            self.left[made], self.right[made] = i, j
        self.length = [0] * n
        self.ids: dict[str, int] = {}
        for token, i in vocab.items():
            s = symbols(token)
            self.ids[s], self.length[i] = i, len(s)
        # Only tokens that their own merges rebuild can occur.
        self.machine = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.machine.add_word(s, i)
        #: Of each token, the longest shorter token that begins it.
        self.shorter = [-1] * n
        for s, i in self.ids.items():
            for k in range(len(s) - 1, 0, -1):
                if (j := self.ids.get(s[:k])) is not None:
                    self.shorter[i] = j
                    break
        self.machine.make_automaton()
        self.most = max(self.length)  # symbols of the longest token
        self.fits: dict[int, bool] = {}
        self.chunks = Cache(self.encode_chunk)
        shown = [""] * (max([n - 1, *self.special.values()]) + 1)
        for token, i in {**vocab, **self.special}.items():
            shown[i] = f" {token}"
        raw = [s.encode() for s in shown]
        self.text = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.offsets = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum([len(b) for b in raw], out=self.offsets[1:])

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b side by side, not asked for before, stay as they are: no merge across their border comes before those that made them."""
        x, y, before, fits = a, b, 1 << 60, True
        while True:
            across = self.pairs.get((x, y))
            if across is not None and across < before:
                fits = False
                break
            # Undo the later of the two merges next to the border; what is tried then must come before it.
            if x > y and self.right[x] != x:
                before, x = x, self.right[x]
            elif self.left[y] != y and y >= x:
                before, y = y + 1, self.left[y]
            elif self.right[x] != x:
                before, x = x, self.right[x]
            else:
                break
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[a << 32 | b] = fits
        return fits

    def encode_symbols(self, s: str) -> list[int]:
        n, length, fits = len(s), self.length, self.fits
        left = set()  # positions that were left for good
        done: list[int] = []
        at, before, apart = 0, -1, False
        longest = self.machine.iter_long(s if n <= SPAN else s[:SPAN])
        safe = n if n <= SPAN else SPAN - self.most
        token = next(longest)[1]
        while True:
            end = at + length[token]
            fit = end not in left
            if fit and before >= 0:
                fit = fits.get(before << 32 | token)
                if fit is None:
                    fit = self.compatible(before, token)
            if fit:
                done.append(token)
                if end == n:
                    return done
                at, before = end, token
                if apart or end >= safe:  # what follows a shorter token is not what the automaton reads next
                    longest, apart = self.machine.iter_long(s[end : end + SPAN]), False
                    safe = n if end + SPAN >= n else end + SPAN - self.most
                token = next(longest)[1]
                continue
            token, apart = self.shorter[token], True
            while token < 0:  # nothing fits here
                left.add(at)
                token = done.pop()
                at -= length[token]
                before = done[-1] if done else -1
                token = self.shorter[token]

    def encode_word(self, word: str) -> bytes:
        s = word if word.isascii() else word.encode("utf-8", "surrogatepass").decode("latin-1")
        ids = array("I", self.encode_symbols(s[:-1] + chr(ord(s[-1]) + 256)))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def plain(self, text: str) -> bytes:
        """Text without special tokens."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        words = WORDS.findall(text)
        if words == [text]:  # a word as it will come up again: what the cache asks for
            return self.encode_word(text)
        return b"".join([self.chunks[w] if w.isalpha() else self.encode_word(w) for w in words])

    def piece(self, text: str) -> bytes:
        """Text in which special tokens stand for themselves."""
        if self.special_at is None or "<|" not in text:
            return self.plain(text)
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += [self.plain(text[at : m.start()]), int(self.special[m[0]]).to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def encode_chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() and chunk.islower() and unicodedata.is_normalized("NFC", chunk):
            return self.encode_word(chunk)
        return self.piece(chunk)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _SEPARATORS.search(text):
            return self.piece(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def decode(self, ids: bytes | None) -> str:
        """Tokens joined by blanks, as the vocabulary's library does where no decoder is set."""
        if not ids:
            return ""
        i = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        starts, lengths = self.offsets[i], self.offsets[i + 1] - self.offsets[i]
        ends = np.cumsum(lengths)
        where = np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
        return self.text[where].tobytes()[1:].decode()


_HELD: dict[int, Codec] = {}


def _codec(shipped) -> Codec:
    text = shipped.value
    key = hash(text)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Codec(text)
    return _HELD[key]


def _ship(spark: SparkSession, path: str | None):
    """The vocabulary goes to the executors as one broadcast text; its size is that of the file (1.7 MB here), whatever the corpus."""
    small_batches(spark)
    return spark.sparkContext.broadcast(vocabulary(path))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids): ids of every text as little-endian unsigned 32-bit integers in one binary value."""
    shipped, names = _ship(docs.sparkSession, path), outputs(id_col, "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped)
        for batch in sliced(batches):
            ids = [codec.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(ids, pa.binary())], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {names[0]} bigint, {names[1]} binary")


def decode(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids, decoded): the text that the ids stand for."""
    shipped, names = _ship(encoded.sparkSession, path), outputs(id_col, "n_tokens", "ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped)
        for batch in sliced(batches):
            texts = [codec.decode(b) for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[id_col, *names])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, *names[:2]).mapInArrow(run, f"`{id_col}` {kind}, {names[0]} bigint, {names[1]} binary, {names[2]} string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """What decode(encode(docs)) gives, in one pass: ids don't leave the worker between the two, which then holds one set of tables a task, not two."""
    shipped, names = _ship(docs.sparkSession, path), outputs(id_col, "n_tokens", "ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped)
        for batch in sliced(batches):
            ids = [codec.encode(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {names[0]} bigint, {names[1]} binary, {names[2]} string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document the count of tokens and the hashes of its ids and of its decoded text."""
    return round_trip(docs, path=path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
