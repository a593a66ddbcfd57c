"""Fill-in-the-middle transformation by content-defined chunks and a cache of their summaries.

A document's tokens are ``[ws]*[other]+|[ws]+`` with the six ASCII blanks, so a
token ends where a word ends, and the last one at the text's end. To cut after
the k-th token, the k-th end must be found:

* a rolling hash over the last 32 bytes cuts each text into chunks where its
  low bits are zero, so a passage that many documents share falls into the same
  chunks in all of them (but for those at its rims);
* a chunk's summary (token ends inside it, code points, whether it begins and
  ends with a blank) is kept in a cache under the chunk's content. The content
  is the key, so a hit is verified by comparing bytes, not only their hash;
* two neighbours join by one rule: a word that ends at their border is one more
  token end. Running sums of the joined counts tell the chunk that holds a cut,
  and only that chunk is scanned for the place.

The output is ``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle``
(spm); texts that hold a sentinel stay plain, so the parts are found again
without doubt: a sentinel begins with ``<`` and ends with ``>``, hence none can
straddle the border between a part and a sentinel.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.llm import texts
from recordlake.llm.ship import ship

BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"  # fixed values of the format
SENTINEL = re.compile(b"<[PSM]>")
TOKEN_END = re.compile(rb"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
ENDING = re.compile(rb"[^\x20\x09-\x0D][\x20\x09-\x0D]")
CONTINUATION = bytes(range(0x80, 0xC0))

WINDOW_STEPS = 5  # the hash reaches back over 2**5 bytes
MASK = np.uint32((1 << 10) - 1)  # a cut every 1024 bytes on average
LEAST, MOST = 256, 8192  # bytes of a chunk
BLOCK_BYTES = 1 << 20  # of a text that are hashed at a time
CACHE_BYTES = 24 << 20  # of chunk contents, in each of two generations
_GEAR = np.random.default_rng(13).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Per byte, the hash of it and the 31 before it (fewer at the start)."""
    h = _GEAR[data]
    for k in range(WINDOW_STEPS):
        step = 1 << k
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cut_places(text: bytes) -> list[int]:
    """Where the chunks of a text end, its length last. They depend on nothing but the bytes: a cut is set where
    the hash of the bytes before it says so, ``LEAST`` bytes after the last one at the earliest, ``MOST`` at the latest."""
    n, reach = len(text), (1 << WINDOW_STEPS) - 1
    places, last = [], 0
    for begin in range(0, n, BLOCK_BYTES):
        end, lead = min(n, begin + BLOCK_BYTES), min(begin, reach)
        h = rolling_hash(np.frombuffer(text, np.uint8, end - begin + lead, begin - lead))[lead:]
        for place in (np.flatnonzero((h & MASK) == 0) + (begin + 1)).tolist():
            while place - last > MOST:
                last += MOST
                places.append(last)
            if place - last >= LEAST:
                last = place
                places.append(last)
    while n - last > MOST:
        last += MOST
        places.append(last)
    if last < n:
        places.append(n)
    return places


@dataclass(frozen=True, slots=True)
class Summary:
    """What a document needs to know of a chunk."""

    ends: int  # token ends inside: a word's last byte with a blank after it
    points: int  # code points that begin in it
    first_blank: bool
    last_blank: bool


def summarise(chunk: bytes) -> Summary:
    return Summary(len(ENDING.findall(chunk)), len(chunk.translate(None, CONTINUATION)), chunk[0] in BLANK, chunk[-1] in BLANK)


class ChunkCache(dict):
    """Chunk content -> summary, for the chunks met of late. When it is full, its entries become the older
    generation, from which those still in use come back."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.held, self.older = limit, 0, {}
        self.made = self.used = 0

    def __missing__(self, chunk: bytes) -> Summary:
        found = self.older.get(chunk)
        if found is None:
            found = summarise(chunk)
            self.made += 1
        if self.held > self.limit:
            self.older, self.held = dict(self), 0
            self.clear()
        self[chunk] = found
        self.held += len(chunk) + 100
        return found


class Cutter:
    """Token counts and cut places of texts; one per task, so that its documents share the cache."""

    def __init__(self):
        self.cache = ChunkCache()

    def tokens(self, text: bytes) -> tuple[int, list[int], list[int], list[int]]:
        """Number of tokens; per chunk where it begins, the token ends before its first byte's own, and the code
        points before it. An end at the border of two chunks counts before the second one."""
        begins, counts, points, ends, chars = [], [], [], 0, 0
        at, open_word = 0, False
        for place in cut_places(text):
            s = self.cache[text[at:place]]
            ends += open_word and s.first_blank
            begins.append(at)
            counts.append(ends)
            points.append(chars)
            ends += s.ends
            chars += s.points
            at, open_word = place, not s.last_blank
        return ends + (len(text) > 0), begins, counts, points

    def place(self, text: bytes, k: int, found: tuple[int, list[int], list[int], list[int]]) -> tuple[int, int]:
        """Bytes and code points up to the end of the k-th token."""
        n, begins, counts, points = found
        if k <= 0:
            return 0, 0
        chunk = bisect_left(counts, k) - 1  # the last chunk with fewer ends before it
        begin = begins[chunk]
        end = begins[chunk + 1] if chunk + 1 < len(begins) else len(text)
        if k == n:
            at = len(text)
        else:
            inner = k - counts[chunk]  # the border's own end comes after those inside
            ends = (m.end() for m in TOKEN_END.finditer(text[begin:end]))
            at = begin + next((e for i, e in enumerate(ends, 1) if i == inner), end - begin)
        return at, points[chunk] + len(text[begin:at].translate(None, CONTINUATION))


def draws(seed: str, doc_id: str) -> list[int]:
    """The first four 32-bit numbers of the SHA-256 of ``seed:id``."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return [int.from_bytes(digest[a:a + 4], "big") for a in range(0, 16, 4)]


def parts(form: str, text: bytes, a: int, b: int) -> list[bytes]:
    """The pieces of the output, in order."""
    if form == "psm":
        return [PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]]
    if form == "spm":
        return [SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]]
    return [text]


def restore(form: str, output: bytes) -> bytes:
    """The text that an output was made of, from the output and its form alone."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    body, middle = output[len(first):].split(MIDDLE, 1)
    one, two = body.split(second, 1)
    return one + middle + two if form == "psm" else two + middle + one


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = texts.buffers(column)
    raw = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield raw[a:b]


@dataclass(frozen=True)
class _Transform:
    seed: str
    plain_percent: int
    spm_percent: int
    digests: bool
    schema: pa.Schema

    def __call__(self):
        cutter = Cutter()

        def one(doc_id: str | None, text: bytes) -> tuple:
            found = cutter.tokens(text)
            n = found[0]
            h1, h2, h3, h4 = draws(self.seed, doc_id or "")
            if not text or SENTINEL.search(text) or h3 % 100 >= 100 - self.plain_percent:
                form, shape, pieces = "plain", (None, None), [text]
            else:
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                a, chars_a = cutter.place(text, low, found)
                b, chars_b = cutter.place(text, high, found)
                form = "spm" if h4 % 100 < self.spm_percent else "psm"
                shape, pieces = (chars_a, chars_b - chars_a), parts(form, text, a, b)
            output = b"".join(pieces)
            if not self.digests:
                return n, form, *shape, output
            back = restore(form, output)
            return n, form, *shape, hashlib.sha256(output).hexdigest(), hashlib.sha256(back).hexdigest()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = list(map(one, batch.column(1).to_pylist(), _texts(batch.column(2))))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(self.schema)[1:])]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=self.schema.names)

        return work


def transform(docs: DataFrame, seed: str = "42", plain_percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id",
              text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per row: id, number of tokens, form (plain, psm or spm), code points of prefix and middle (null if plain) and
    the output, or (``digests``) the SHA-256 of the output and of the text rebuilt from output and form.

    The cuts and the form follow from ``seed`` and the id in decimal, so a rerun
    or a lost task gives the same rows. Null text counts as empty and is plain
    with 0 tokens; a null id draws like an empty one. Repeated rows pass through
    row by row; other columns, whatever their names, are not read. Whole texts,
    however long, hashed in blocks of ``BLOCK_BYTES``. No shuffle.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    tail = "output_sha256 string, restored_sha256 string" if digests else "output string"
    schema = f"{id_col} {kind}, n long, form string, prefix_chars long, middle_chars long, {tail}"
    types = [pa.null(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *([pa.string()] * (2 if digests else 1))]
    names = [part.split()[0] for part in schema.split(", ")]
    task = _Transform(seed, plain_percent, spm_percent, digests, pa.schema(list(zip(names, types))))
    rows = docs.select(F.col(id_col), F.col(id_col).cast("string").alias("_id_text"), F.col(text_col).alias("_text"))
    return texts.map_rows(rows, [id_col, "_id_text", "_text"], task, schema)


def restored(outputs: DataFrame, column: str = "output", form: str = "form") -> DataFrame:
    """The rows of ``transform`` with ``text``, rebuilt from output and form by built-in functions."""
    out, kind = F.col(column), F.col(form)

    def between(first: str, last: str | None):
        begin = F.locate(first, out) + len(first)
        end = F.length(out) + 1 if last is None else F.locate(last, out)
        return F.substr(out, begin, end - begin)

    psm = F.concat(between("<P>", "<S>"), between("<M>", None), between("<S>", "<M>"))
    spm = F.concat(between("<P>", "<M>"), between("<M>", None), between("<S>", "<P>"))
    return outputs.withColumn("text", F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(out))
