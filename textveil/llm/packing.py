"""Hierarchical multi-length packing of tokenised documents.

Documents are tokenised (tokenizers file, its path a parameter), get the end id,
and are dealt by a hash of id and tokens into buckets of about `bucket_bytes` bytes of
text. In each bucket: documents longer than the largest window give full windows,
the rest is routed to the smallest context-size tier that holds it; each tier is
packed best-fit; gaps of long windows are filled from the pieces of shorter tiers,
cut where the gap ends; what is left over is cut to full windows of ever smaller
tiers, so only a tail under the smallest tier is padded. Sequences are dealt into
step groups of about equal token counts and lengths, longest first. Ids are those of
the tokenizer, added tokens in a text included.

Defined results: null text is the empty text (its end id alone); rows that repeat
a doc_id are packed each; an empty table gives no rows; other columns are not
read. Memory: one bucket's ids (2 bytes each, 4 for larger vocabularies) in one task; a document longer than
a bucket makes its bucket that much larger.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm import ids, workers

TIERS = (512, 1024, 2048, 4096)
LEAST = 16  # the smallest window that a bucket's last ids are cut to
END_ID = 2
BUCKET_BYTES = 24_000_000
STEP_TOKENS = 1 << 18
CACHE_WORDS = 300_000
STORE = "word ids"

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_length long, tier int, step_group long, ids binary"
)


def _byte_chars() -> list[str]:
    """Characters that stand for the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordIds(dict):
    """Word -> its ids as bytes, for tokenizers that lower-case and whose ids of a text are
    those of its words between white space, in order (probed; others get whole texts). Words that are letters with
    trailing ASCII punctuation go to the BPE model at once, others to the whole
    tokenizer. Bounded: emptied when `size` words are held."""

    _simple = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-^`{-~]*)")

    def __init__(self, path: str, size: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # an added token is found in a text before its words are: such texts go to the whole tokenizer
        self.added = {t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.size, self.tails = size, {}
        self.largest = max(self.tokenizer.get_vocab().values(), default=0)
        self.chars = _byte_chars()
        probe = "déjà vu, the façade... naïve!! größe"
        self.direct = [i for w in probe.split() for i in np.frombuffer(self._of_word(w), "<u4")] == self.tokenizer.encode(probe, add_special_tokens=False).ids
        self.clear()
        self.by_word = b"".join(map(self._whole, self._probe.lower().split())) == self._whole(self._probe)

    def _model(self, part: str, held: dict) -> bytes:
        got = held.get(part)
        if got is None:
            if len(held) >= self.size:
                held.clear()
            word = part if part.isascii() else "".join(map(self.chars.__getitem__, part.encode()))
            got = np.array([t.id for t in self.tokenizer.model.tokenize(word)], dtype="<u4").tobytes()
            held[part] = got
        return got

    def _of_word(self, word: str) -> bytes:
        """Ids of letters, which are a word themselves, and of what trails them."""
        m = self._simple.fullmatch(word)
        return self._model(m[1], self) + (self._model(m[2], self.tails) if m[2] else b"")

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.size:
            self.clear()
        if self.direct and self._simple.fullmatch(word):
            got = self._of_word(word)
        else:
            got = self._whole(word)
        self[word] = got
        return got

    _odd = "\x1c\x1d\x1e\x1fİΣ"  # split or lower-cased otherwise by Python
    _probe = "Déjà vu,  the façade...\n\tnaïve!! GRÖSSE it's 3.14 [x] a_b\r\n\n漢字 don't"

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def of_text(self, text: str) -> bytes:
        lower = text.lower()
        if not self.by_word or any(c in text for c in self._odd) or any(a in lower for a in self.added):
            return self._whole(text)
        return b"".join(map(self.__getitem__, lower.split()))


def word_ids(path: str) -> WordIds:
    """One for each worker process and file."""
    held = workers.store(STORE)
    if path not in held:
        held[path] = WordIds(path)
    return held[path]


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document index, start, length) that hold each document's ids
    once. Every sequence but the last few ids' is a full power-of-two window."""
    top = tiers[-1]
    sequences: list[list[tuple[int, int, int]]] = []
    routed: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for doc, n in enumerate(lengths):
        full = n - n % top
        sequences += [[(doc, start, top)] for start in range(0, full, top)]
        if n > full:
            routed[next(t for t in tiers if t >= n - full)].append((doc, full, n - full))
    shorter: list[tuple[int, int, int]] = []  # waits to fill gaps, longest last
    for t in tiers:  # the shortest tier first: what it can't fill goes up
        open_windows: dict[int, list[list[tuple[int, int, int]]]] = {}
        rooms: list[int] = []  # of the open windows, sorted
        for piece in sorted(routed[t], key=lambda p: (-p[2], p[0])):
            # best fit: the window with the least room that still holds the piece
            at = bisect_left(rooms, piece[2])
            room = rooms[at] if at < len(rooms) else None
            window = open_windows[room].pop() if room else []
            if room and not open_windows[room]:
                del rooms[at], open_windows[room]
            left = (room or t) - piece[2]
            window.append(piece)
            if left:
                if left not in open_windows:
                    insort(rooms, left)
                open_windows.setdefault(left, []).append(window)
            else:
                sequences.append(window)
        for room in sorted(open_windows):
            for window in open_windows[room]:
                left = room
                while left and shorter:
                    doc, start, n = shorter.pop()
                    took = min(n, left)
                    window.append((doc, start, took))
                    left -= took
                    if took < n:
                        shorter.append((doc, start + took, n - took))
                if left:
                    shorter += window  # not filled: its pieces wait for a longer window
                else:
                    sequences.append(window)
    total = sum(p[2] for p in shorter)
    size = top
    while shorter:  # full windows of ever smaller powers of two, then a short tail
        while size > total and size > least:
            size //= 2
        window, left = [], min(size, total)
        while left:
            doc, start, n = shorter.pop()
            took = min(n, left)
            window.append((doc, start, took))
            left -= took
            if took < n:
                shorter.append((doc, start + took, n - took))
        total -= sum(p[2] for p in window)
        sequences.append(window)
    return sequences


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """Step of each sequence: the longest first, each to the step that has the fewest tokens
    so far, so that steps hold about equal counts of tokens and of each length."""
    steps = max(1, round(sum(sizes) / step_tokens))
    held = [(0, s) for s in range(steps)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        total, step = held[0]
        out[i] = step
        heapq.heapreplace(held, (total + sizes[i], step))
    return out


def tokenized(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 16-bit numbers, or 32-bit for larger vocabularies."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(tokenizer_path)
        width = np.dtype("<u2" if max(words.largest, end_id) < 1 << 16 else "<u4")
        for pdf in batches:
            narrow = [np.frombuffer(words.of_text(t or "") + end, "<u4").astype(width).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(p) // width.itemsize for p in narrow], "ids": narrow})

    rows = docs.select(ids.filled(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(workers.lean(run, STORE), "doc_id long, n_tokens long, ids binary")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    text: str = "text",
    doc_id: str = "doc_id",
    end_id: int = END_ID,
    tiers: tuple[int, ...] = TIERS,
    bucket_bytes: int = BUCKET_BYTES,
    step_tokens: int = STEP_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """One row for each piece of a document in a sequence; ids: that piece's, as in tokenized()."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    buckets = max(1, -(-((size["b"] or 0) + 8 * size["n"]) // bucket_bytes))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens", "ids"], kind="stable").reset_index(drop=True)
        bucket = int(pdf["bucket"].iloc[0])
        docs_of, lengths, blobs = pdf["doc_id"].tolist(), pdf["n_tokens"].tolist(), pdf["ids"].tolist()
        out, sequences = [], plan(lengths, tiers)
        sizes = [sum(p[2] for p in q) for q in sequences]
        for number, (sequence, total, step) in enumerate(zip(sequences, sizes, step_groups(sizes, step_tokens), strict=True)):
            at, group = 0, (bucket << 32) + step
            tier = next(t for t in tiers if t >= total)
            for doc, start, n in sequence:
                width = len(blobs[doc]) // lengths[doc]  # bytes an id
                part = blobs[doc][width * start : width * (start + n)]
                crc = zlib.crc32(np.frombuffer(part, f"<u{width}").astype("<u4").tobytes())
                out.append((docs_of[doc], start, n, crc, lengths[doc], (bucket << 32) + number, at, total, tier, group, part if with_ids else None))
                at += n
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "tier", "step_group", "ids"])

    rows = tokenized(docs, tokenizer_path, text, doc_id, end_id)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(buckets)).cast("long"))
    return rows.groupBy("bucket").applyInPandas(run, PIECES).withColumn("doc_id", ids.emptied("doc_id"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, tokenizer_path(), with_ids=False).drop("ids")
