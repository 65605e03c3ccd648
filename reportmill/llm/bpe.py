"""BPE encoding and decoding by prefix-sharing trie traversal.

A BPE encoding is right exactly when each pair of neighbouring tokens is the encoding of their joined
text. So the last token of a prefix's encoding is the one token that ends the prefix and goes with
the last token of what stands before it. The distinct words of a batch are walked in the order of a
trie: going one symbol down adds one last token, going up forgets it, and words that share a prefix
share its states. A word's ids are then read back along the last tokens. The pair test merges the few
symbols of two tokens by rank and is remembered.

Texts become words as in the tokenizer file: special tokens first, then canonical composition,
lower case letter by letter, the file's split pattern, and bytes as printable characters, with an
end-of-word mark on the last. The file is read once by the driver and sent to the executors (a fixed
size). Texts stream through the workers in Arrow batches; a worker remembers the ids of chunks between
white space and the outcome of pair tests up to a bounded number of bytes. Both are held in two generations:
when the young one is full it becomes the old one, whose entries come back when they are used, so what is
common is never worked out twice and forgetting costs time only. :func:`digests` encodes, decodes and hashes
in one pass through one worker.

Defined results: null and empty texts have no ids and decode to the empty text; the text is used
whole however long; repeated rows get equal results; other columns pass through, whatever their names; an
empty table gives an empty table. Text of a special token counts as that token, as the library does by default.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reportmill.llm.common import col, documents, fresh

SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
END = "</w>"
#: Bytes (about) of chunks that a worker remembers, and what an entry takes besides its text and ids.
REMEMBERED, ENTRY = 64 << 20, 220
#: Pair tests that a worker remembers: about 170 bytes each.
TESTS = 400_000
#: Sizes of tokens that may end any prefix.
SHORT = (2, 1)
#: Bytes of text that are cut into chunks at a time, but for a single longer text.
BATCH_BYTES = 2 << 20


def byte_characters() -> dict[int, str]:
    """Each byte's printable character: itself where printable, else the next free one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in out:
            out[b], free = chr(free), free + 1
    return out


class TrieBpe:
    """Encoder and decoder of one tokenizer file's content."""

    def __init__(self, content: str):
        import regex

        d = json.loads(content)
        model = d["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.inner, self.final = self.sizes_by_ending("", END), self.sizes_by_ending(END, None)
        self.bytes = byte_characters()
        self.table = {b: c for b, c in self.bytes.items()}
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
        self.gaps = regex.compile(f"[{SPACES}]+")
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.fits: dict[tuple[str, str], bool] = {}
        self.old_fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}
        self.held = 0

    # --- pair test

    @staticmethod
    def symbols(token: str) -> list[str]:
        if token.endswith(END) and len(token) > len(END):
            body = token[: -len(END)]
            return [*body[:-1], body[-1] + END]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """Merges by rank, leftmost first, until no pair has a rank."""
        rank = self.rank.get
        none = len(self.rank)
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: rank(p, none))  # noqa: B905
            if best not in self.rank:
                break
            out, i, joined = [], 0, best[0] + best[1]
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == best[0] and parts[i + 1] == best[1]:
                    out.append(joined)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def goes(self, a: str, b: str) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            known = self.old_fits.get((a, b))
            if known is None:
                known = (a, b) not in self.rank and self.merged([*self.symbols(a), *self.symbols(b)]) == [a, b]
            if len(self.fits) >= TESTS // 2:
                self.old_fits, self.fits = self.fits, {}
            self.fits[a, b] = known
        return known

    def alone(self, t: str) -> bool:
        known = self.whole.get(t)
        if known is None:
            known = self.whole[t] = self.merged(self.symbols(t)) == [t]
        return known

    # --- trie traversal

    def sizes_by_ending(self, end: str, other: str | None) -> dict[str, tuple[int, ...]]:
        """The sizes of tokens with one end mark and not the other, largest first, by the last three of their symbols."""
        found: dict[str, set[int]] = {}
        for t in self.vocab:
            if t.endswith(end) and not (other and t != other and t.endswith(other)):
                body = t[: len(t) - len(end)]
                if len(body) > 2:
                    found.setdefault(body[-3:], set()).add(len(body))
        return {e: (*sorted(sizes, reverse=True), *SHORT) for e, sizes in found.items()}

    def last(self, word: str, n: int, lasts: list[str], end: str) -> str:
        """The last token of the word's first n symbols; lasts[i] is that of its first i."""
        vocab, fits = self.vocab, self.fits
        for size in (self.final if end else self.inner).get(word[n - 3 : n], SHORT) if n > 2 else SHORT[-n:]:
            t = word[n - size : n] + end if size <= n else ""
            if t in vocab:
                if size == n:
                    if self.alone(t):
                        return t
                else:
                    known = fits.get((lasts[n - size], t))
                    if self.goes(lasts[n - size], t) if known is None else known:
                        return t
        raise ValueError(f"no token ends {word[:n]!r}")

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Ids of distinct words (as byte characters), depth first over their trie."""
        out: dict[str, list[int]] = {}
        vocab, lasts, before = self.vocab, [""], ""
        for word in sorted(words):
            inner = len(word) - 1
            shared, most = 0, min(len(before) - 1, inner)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del lasts[shared + 1 :]
            for depth in range(shared + 1, inner + 1):
                lasts.append(self.last(word, depth, lasts, ""))
            t = self.last(word, inner + 1, lasts, END)
            ids, at = [vocab[t]], inner + 1 - (len(t) - len(END))
            while at:
                t = lasts[at]
                ids.append(vocab[t])
                at -= len(t)
            out[word] = ids[::-1]
            before = word
        return out

    # --- texts

    def lowered(self, s: str) -> str:
        if s.isascii():
            return s.lower()
        s = unicodedata.normalize("NFC", s)
        return "".join(c.lower() for c in s) if "\u03a3" in s else s.lower()

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is special, text) in order."""
        if self.specials is None or "<" not in text:
            yield False, text
            return
        for i, part in enumerate(self.specials.split(text)):
            if part:
                yield bool(i % 2), part

    def split(self, text: str) -> list[str]:
        text = self.lowered(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python only
            return self.gaps.split(text)
        return text.split()

    def learn(self, chunks: set[str]) -> None:
        size = lambda c: 3 * len(c) + ENTRY
        missing = [c for c in chunks if c not in self.chunks]
        if not missing:
            return
        self.held += sum(map(size, missing))
        if self.held > REMEMBERED // 2:
            self.old_chunks, self.chunks = self.chunks, {}
            missing, self.held = list(chunks), sum(map(size, chunks))
        new = []
        for c in missing:
            ids = self.old_chunks.pop(c, None)
            if ids is None:
                new.append(c)
            else:
                self.chunks[c] = ids
        plain = lambda w: w.isascii() and w.isprintable()  # these bytes are their own characters
        as_bytes = lambda w: w if plain(w) else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table)
        parts = {c: [c] if c.isascii() and c.isalpha() else [as_bytes(w) for w in self.words.findall(c)] for c in new}
        ids = self.encode_words({w for ws in parts.values() for w in ws})
        for c, ws in parts.items():
            self.chunks[c] = array("I", [i for w in ws for i in ids[w]]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text: four little-endian bytes an id.

        The collector rests meanwhile: a batch makes very many tuples and lists and no cycles.
        """
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self.packed(texts)
        finally:
            if collecting:
                gc.enable()

    def packed(self, texts: list[str]) -> list[bytes]:
        cut = [[(special, x if special else self.split(x)) for special, x in self.pieces(t)] for t in texts]
        self.learn({c for parts in cut for special, x in parts if not special for c in x})
        known = self.chunks
        packed = lambda special, x: self.special[x].to_bytes(4, "little") if special else b"".join([known[c] for c in x])
        return [b"".join(packed(*part) for part in parts) for parts in cut]

    def decode(self, ids: bytes) -> str:
        names = self.names
        return " ".join([names[i] for i in array("I", ids)])


_loaded: dict[int, TrieBpe] = {}


def _bpe(content: str) -> TrieBpe:
    """One encoder a worker process."""
    key = hash(content)
    if key not in _loaded:
        _loaded[key] = TrieBpe(content)
    return _loaded[key]


def _batches(it, text_at: int):
    """Smaller batches by bytes of text."""
    for batch in it:
        sizes, start, size = pc.binary_length(batch.column(text_at)).to_pylist(), 0, 0
        for i, n in enumerate(sizes):
            if size and size + (n or 0) > BATCH_BYTES:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < len(sizes):
            yield batch.slice(start)


def encode(
    docs: DataFrame, tokenizer: str, *, text: str = "text", names: tuple[str, str] = ("ids", "n_tokens")
) -> DataFrame:
    """Adds ``ids`` (binary, four little-endian bytes an id) and ``n_tokens``. tokenizer: the file's path on the driver."""
    with open(tokenizer, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    ids, count = fresh(docs, *names)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())])
    at = docs.columns.index(text)

    def work(it):
        bpe = _bpe(content.value)
        for batch in _batches(it, at):
            packed = bpe.encode([t or "" for t in batch.column(at).to_pylist()])
            more = [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, ids, count])

    return docs.mapInArrow(work, schema)


def decode(df: DataFrame, tokenizer: str, *, ids: str = "ids", name: str = "decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds the decoded text of packed ids: the tokens' names with blanks between, as the file names no decoder."""
    with open(tokenizer, encoding="utf-8") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())
    (out,) = fresh(df, name)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    at = df.columns.index(ids)

    def work(it):
        bpe = _bpe(content.value)
        for batch in _batches(it, at):
            texts = [bpe.decode(x or b"") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(work, schema).drop(*drop)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, tokenizer: str | None = None, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: number of ids and digests of the ids and of the decoded text, all from one pass."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), *[T.StructField(n, k) for n, k in DIGESTS]])
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def work(it):
        bpe = _bpe(content.value)
        for batch in _batches(it, 1):
            packed = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
            more = [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([sha(p) for p in packed]), pa.array([sha(bpe.decode(p).encode()) for p in packed])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *more], names=["doc_id", *[n for n, _ in DIGESTS]])

    return docs.select(col(key), col(text)).mapInArrow(work, schema)


DIGESTS = (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
