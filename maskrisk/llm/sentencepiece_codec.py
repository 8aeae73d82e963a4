"""SentencePiece encoding by a streaming Viterbi search, and decoding.

Each boundary of a text keeps one surviving backpointer. In a vocabulary of scores (unigram) it is that of the best sum.
In a vocabulary of merges (BPE) ids are not a best sum but what greedy merging gives: the merged form of every beginning
is the merged form of a shorter beginning and one piece more, and a piece may follow another exactly if merging the two
alone leaves both as they are; so all paths into a boundary but one are ruled out. Only boundaries that no more than the
longest piece separates from the last read character can still be extended. Where the paths back from all of them meet,
ids are final and leave the window.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

SPACE = "▁"
#: Stretches of text, and pairs of pieces, that a Python worker remembers.
REMEMBERED_STRETCHES, REMEMBERED_PAIRS = 500_000, 1_000_000
#: In place of an id: the beginning of a stretch, and a character that no piece has.
START, UNKNOWN = -1, -2

_codecs: dict[str, Codec] = {}


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in a model file; floats stay as their four bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            at += 1
            value |= (raw[at - 1] & 127) << shift
            shift += 7
            if raw[at - 1] < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[at : at + n]
            at += n


class Codec:
    """A vocabulary file in a Python worker.

    Supported are unigram and BPE models that keep texts as they are but for an optional blank in front. Others (word
    and character models, normalising ones, pieces defined by users) would get wrong ids and raise ValueError.
    """

    #: Characters that are looked at together, up to the next place that no piece spans.
    SLICE = 1 << 16

    def __init__(self, path: str | None = None, raw: bytes | None = None):
        from sentencepiece import SentencePieceProcessor

        if raw is None:
            with open(path, "rb") as file:
                raw = file.read()
        parts = list(fields(raw))
        trainer, form = (dict(fields(next((v for k, v in parts if k == n), b""))) for n in (2, 3))
        kinds = [dict(fields(v)).get(3, 1) for k, v in parts if k == 1]
        self.merges, self.prefix = trainer.get(3, 1) == 2, SPACE if form.get(3, 1) else ""
        wrong = {"kind of model": trainer.get(3, 1) not in (1, 2), "blanks behind words": trainer.get(24, 0), "normalisation": form.get(2, b""), "removal of blanks": form.get(4, 1), "unescaped blanks": not form.get(5, 1), "pieces defined by users": 4 in kinds}
        if any(wrong.values()):
            raise ValueError("not supported: " + ", ".join(k for k, v in wrong.items() if v))
        sp = SentencePieceProcessor(model_proto=raw)
        n = sp.get_piece_size()
        self.ids = {sp.id_to_piece(i): i for i in range(n) if kinds[i] == 1}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.score = [sp.get_score(i) for i in range(n)]
        self.poor = min(self.scores.values()) - 10  # of a character that no piece has, by definition of the format
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.surface: list[str | int] = ["" if sp.is_control(i) else sp.id_to_piece(i).replace(SPACE, " ") for i in range(n)]
        for value, i in self.bytes.items():
            self.surface[i] = value
        self.longest = max(map(len, self.ids))
        self.name = [sp.id_to_piece(i) for i in range(n)]
        self.trie: dict = {}  # character to [id or -1, what follows]
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                step = node.setdefault(c, [-1, {}])
                node = step[1]
            step[0] = i
        # no piece has a space sign behind another character, or a line feed: every path has a boundary there
        apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        lines = "" if any("\n" in p for p in self.ids) else "\n"
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}{lines}]+|{SPACE}+|\n" if apart else r"(?s).+")
        self.cut = re.compile(f"(?<![ {SPACE}]) " + ("|\n" if lines else "")) if apart else None
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.commits = self.peak = 0  # how often paths met before the end, and the longest window so far

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging its best neighbours until none are left."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether merging leaves piece ``b`` behind piece ``a``; with START or UNKNOWN, whether it makes ``b`` at all."""
        left, right = self.name[a] if a >= 0 else "", self.name[b]
        out = self.merged(left + right) == ([left, right] if left else [right])
        if len(self.pairs) < REMEMBERED_PAIRS:
            self.pairs[(a + 2) << 20 | b] = out
        return out

    def pieces(self, text: str) -> Iterator[list[tuple[int, int]]]:
        """(id, length) of the pieces of a stretch of any length, as soon as they are final.

        The window begins where paths last met. Once it is as long as the longest piece, ids are final at the first place
        that no piece spans; where none comes, the paths back are followed after each ``longest`` characters. So the
        window is a few times the longest piece, plus how far paths run apart.
        """
        pairs, follows, trie, longest, score = self.pairs, self.follows, self.trie, self.longest, self.score
        n, base, at, reach, look, peak, merges = len(text), 0, 0, 0, 2 * longest, self.peak, self.merges
        room = min(n, 4 * longest)
        ids, sizes = [START] + [UNKNOWN] * room, [0] * (room + 1)  # surviving backpointers at boundaries from base on; size 0: none yet
        sums = [0.0] if merges else [0.0] * (room + 1)
        while at < n:
            here = at - base
            if room < here + longest and room < n - base:
                ids += [UNKNOWN] * room
                sizes += [0] * room
                sums += [0.0] * (0 if merges else room)
                room *= 2
            before, node, to = ids[here], trie, at
            head, single = (before + 2) << 20, False
            while to < n and (step := node.get(text[to])) is not None:
                piece, node = step
                to += 1
                if piece < 0:
                    continue
                if merges:
                    if not sizes[to - base]:
                        ok = pairs.get(head | piece)
                        if ok is None:
                            ok = follows(before, piece)
                        if ok:
                            ids[to - base], sizes[to - base] = piece, to - at
                            if to > reach:
                                reach = to
                else:
                    single, sum_ = single or to == at + 1, sums[here] + score[piece]
                    if not sizes[to - base] or sum_ > sums[to - base]:
                        ids[to - base], sizes[to - base], sums[to - base] = piece, to - at, sum_
                        if to > reach:
                            reach = to
            at += 1
            here += 1
            if merges:
                if not sizes[here]:  # no piece ends here: a character on its own
                    sizes[here] = 1
            elif not single and (not sizes[here] or sums[here - 1] + self.poor > sums[here]):
                ids[here], sizes[here], sums[here] = UNKNOWN, 1, sums[here - 1] + self.poor
            if at >= reach:  # the one boundary that is left: paths meet here
                reach = at
                if longest <= here < n - base:  # a shorter window can wait
                    self.commits += 1
                    yield self._back(ids, sizes, here)
                    base, look, room = at, 2 * longest, min(n - at, 4 * longest)
                    ids, sizes = [ids[here]] + [UNKNOWN] * room, [0] * (room + 1)
                    sums = [0.0] if merges else [sums[here]] + [0.0] * room
            elif here >= look:
                peak, look = max(peak, reach - base), here + longest
                path, walk, meet = set(), here, here
                while walk > 0:
                    path.add(walk)
                    walk -= sizes[walk]
                for frontier in range(here + 1, reach - base + 1):
                    walk = frontier if sizes[frontier] else meet
                    while walk > 0 and walk not in path:
                        walk -= sizes[walk]
                    meet = min(meet, walk)
                if meet > 0:
                    self.commits += 1
                    yield self._back(ids, sizes, meet)
                    ids, sizes, sums = ids[meet:], sizes[meet:], sums if merges else sums[meet:]
                    base, look, room = base + meet, max(look - meet, 2 * longest), room - meet
        self.peak = max(peak, n - base)
        yield self._back(ids, sizes, n - base)

    @staticmethod
    def _back(ids: list[int], sizes: list[int], to: int) -> list[tuple[int, int]]:
        out = []
        while to > 0:
            out.append((ids[to], sizes[to]))
            to -= sizes[to]
        return out[::-1]

    def packed(self, stretch: str) -> bytes:
        out: list[int] = []
        at = 0
        for found in self.pieces(stretch):
            for i, size in found:
                if i >= 0:
                    out.append(i)
                elif self.bytes:
                    out += [self.bytes[b] for b in stretch[at : at + size].encode("utf-8", "surrogatepass")]
                else:
                    out.append(self.unknown)
                at += size
        ids = struct.pack(f"<{len(out)}I", *out)
        if len(self.known) < REMEMBERED_STRETCHES and len(stretch) < 64:
            self.known[stretch] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text. It is read as one stream: ids leave it at each place that no piece spans, and those of
        stretches between such places are remembered."""
        if not text:
            return b""
        out, at, n = [], 0, len(text)
        while at < n:
            cut = self.cut.search(text, at + self.SLICE) if self.cut and at + self.SLICE < n else None
            end = cut.start() if cut else n
            stretches = self.stretch.findall((self.prefix if not at else "") + text[at:end].replace(" ", SPACE))
            at = end
            ids = list(map(self.known.get, stretches))
            if None in ids:
                ids = [self.packed(s) if x is None else x for s, x in zip(stretches, ids, strict=True)]
            out += ids
        return b"".join(out)

    def decode(self, raw: bytes) -> str:
        out, run, surface = [], bytearray(), self.surface
        for (i,) in struct.iter_unpack("<I", raw):
            s = surface[i]
            if isinstance(s, int):
                run.append(s)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(s)
        if run:
            out.append(run.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if self.prefix and text.startswith(" ") else text


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) for every row: the whole text's ids as little-endian unsigned 32-bit numbers; none for null or empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                ids = [codec(model_path).encode(x.as_py() or "") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return ship(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, text) for every row of (doc_id, ids): the text that the ids stand for; empty for null or no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [codec(model_path).decode(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    return ship(encoded).select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 and decoded_sha256 (of the text that the ids decode to) for every row of ``docs``."""
    made = decode(encode(docs, model_path), model_path)
    return made.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))
