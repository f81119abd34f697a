"""Byte-pair pieces of a sentencepiece model: encoding by a score-ordered agenda of adjacent
symbol pairs, checked against the library in each Arrow batch, and decoding."""

from __future__ import annotations

import heapq
import re
from itertools import chain
from math import inf

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, list_column, pick, slices

SPACE = "▁"
#: Segments are remembered in two generations of up to so many, so about 60 MB at most.
SEGMENTS = 125_000
#: Up to so many characters the agenda is a list, beyond it a heap. The pieces are the same.
SHORT = 40
#: Longer segments are not remembered.
REMEMBERED = 32


class Mismatch(RuntimeError):
    """The agenda and the library gave different pieces."""


class PieceEncoder:
    """Ids of a text under a merge-type model with byte fallback and no text normalization.

    Characters that stand together in no piece are never joined, so a text can be cut between
    them, and each segment is encoded alone and remembered. Texts are cut before space
    marks, around line feeds, and between letters or digits and other characters. Whether
    the vocabulary allows this is found on loading; texts with a pair of characters that
    a piece does join are cut at spaces only, or not at all. Every segment is compared
    with the library when it is first seen in a process.
    """

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.ids, self.score = {}, {}
        for i in range(m.vocab_size()):
            piece = m.id_to_piece(i)
            if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)):
                self.ids[piece], self.score[piece] = i, m.get_score(i)
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if m.unk_id() in self.bytes:
            raise ValueError("the model has no byte fallback")
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        feed = any("\n" in p and len(p) > 1 for p in self.ids)
        coarse = "(?s).+" if inner or feed else f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+"
        self.coarse = re.compile(coarse)
        self.fine = re.compile(f"{SPACE}*[^\\W_]+|{SPACE}*(?:[^\\w{SPACE}\n]|_)+|{SPACE}+|\n")
        mixed = {a + b for p in map(str.lstrip, self.ids, [SPACE] * len(self.ids)) for a, b in zip(p, p[1:]) if a.isalnum() != b.isalnum()}
        self.mixed = re.compile("(?s)." if inner or feed else "|".join(map(re.escape, sorted(mixed))) or "(?!)")
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def segment_ids(self, text: str) -> tuple[int, ...]:
        """Take the best-scored adjacent pair that is a piece, the leftmost on a tie, join
        it, offer its new neighbours, until the agenda is empty."""
        ids, fallback = self.ids, self.bytes
        out: list[int] = []
        for s in self.short_agenda(text) if len(text) <= SHORT else self.long_agenda(text):
            if s in ids:
                out.append(ids[s])
            else:
                out += [fallback[b] for b in s.encode()]
        return tuple(out)

    def short_agenda(self, text: str) -> list[str]:
        """The agenda as a list of the scores of all adjacent pairs: for a few symbols a search
        through it is quicker than a heap."""
        symbols, get, never = list(text), self.score.get, -inf
        agenda = [get(text[k:k + 2], never) for k in range(len(text) - 1)]
        while agenda and (best := max(agenda)) > never:
            k = agenda.index(best)
            symbols[k] += symbols.pop(k + 1)
            del agenda[k]
            if k < len(agenda):
                agenda[k] = get(symbols[k] + symbols[k + 1], never)
            if k:
                agenda[k - 1] = get(symbols[k - 1] + symbols[k], never)
        return symbols

    def long_agenda(self, text: str) -> list[str]:
        """The agenda as a heap; a pair with a joined side is skipped when its turn comes."""
        score = self.score
        symbols: list[str | None] = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(-score[p], k, k + 1, p) for k in range(n - 1) if (p := text[k:k + 2]) in score]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            if symbols[left] is None or symbols[right] is None or len(symbols[left]) + len(symbols[right]) != len(piece):
                continue  # one side has been joined meanwhile
            symbols[left], symbols[right] = piece, None
            after[left] = k = after[right]
            if k < n:
                before[k] = left
                if (p := piece + symbols[k]) in score:
                    heapq.heappush(agenda, (-score[p], left, k, p))
            k = before[left]
            if k >= 0 and (p := symbols[k] + piece) in score:
                heapq.heappush(agenda, (-score[p], k, left, p))
        return [s for s in symbols if s is not None]

    def _check(self, segments: list[str]) -> None:
        """Compare with the library. It puts a space mark before a text, so a segment that has
        one leaves it off, and another one is put after a line feed."""
        asked = [s[1:].replace(SPACE, " ") if s[0] == SPACE else "\n" + s for s in segments]
        lead = (self.ids[SPACE], self.bytes[10]) if SPACE in self.ids else None
        for segment, text, want in zip(segments, asked, self.model.encode(asked, num_threads=1)):
            if not text:
                continue  # a lone mark: the library encodes no empty text
            got = self.known[segment]
            if list(got if segment[0] == SPACE else (*lead, *got)) != want:
                raise Mismatch(f"segment {segment!r}: {list(got)} where the library has {want}")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; texts and segments are compared with the library as the class
        says, the first text as a whole."""
        cut = [(self.coarse if self.mixed.search(t) else self.fine).findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > SEGMENTS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = {s for segments in cut for s in segments if s not in known}
        again = {s for s in new if s in older}
        known.update((s, older[s]) for s in again)
        new -= again
        for s in new:
            known[s] = self.segment_ids(s)
        if new:
            self._check(list(new))
        out = [list(chain.from_iterable([known[s] for s in segments])) for segments in cut]
        for s in new:
            if len(s) > REMEMBERED:
                del known[s]
        if texts and out[0] != self.model.encode(texts[0]):
            raise Mismatch("a whole text differs from the library's pieces")
        return out


def encode_pieces(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array<int>), decoded.

    ids are those of the sentencepiece library for the whole text, without begin or end ids
    and without sampling; decoded is what the library's decode gives for them. The model
    file is read on every executor. A null or empty text has no ids and decodes to the
    empty text. Rows are independent: repeated rows, null ids and any other columns are
    fine. An empty table gives an empty result. A difference from the library raises.
    """
    def run(batches):
        encoder = PieceEncoder(model_path)
        for batch in slices(batches, "text"):
            ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            decoded = encoder.model.decode(ids, num_threads=1) if ids else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), list_column([np.array(x, np.int32) for x in ids], pa.int32()), pa.array(decoded, pa.string())],
                names=["doc_id", "ids", "decoded"])
            ids = decoded = None

    return in_batches(pick(docs, doc_id=doc_id, text=text), run, "doc_id long, ids array<int>, decoded string")


def piece_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``encode_pieces``."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
