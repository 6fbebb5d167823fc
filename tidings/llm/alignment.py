"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which ids that links.

Both tokenizers read space+text. A transducer walks their tokens: its state is the side that leads and the bytes of its last
token that the other side has not matched yet (the dangling suffix). The next token comes from the side that lags; it eats
from the suffix, or eats it whole and leads from there on. An empty suffix closes a group. Transitions are remembered by
state and token, so a byte is compared once for each transition that occurs and not for each token.

Texts are cut at single spaces between other characters: byte-level BPE with the usual splitting pattern breaks there, and so do
pieces of which none holds a space behind another character (asked of the vocabularies; else whole texts are one cut). Both
sides' tokens end at such a cut, so groups of a text are those of its cuts in a row, and a cut is encoded and aligned once for
each task.

The counts of linked ids are corpus-wide: texts travel in blocks of about BLOCK bytes. A block holds its distinct cuts, the cuts'
links, its distinct id pairs with how often it has them, and the documents as cut numbers. Pairs are summed over all
blocks, and each block gets the counts of its own pairs back: nothing is broadcast, a pair that is everywhere costs one row a
block, and nothing larger than a block's own pairs meets in a row.

Null and empty texts have no tokens, nor has a text whose joined bytes under either tokenizer differ from space+text (such as one that
holds U+2581): zeros and an empty groups_sha256. Repeated rows count each; rows without doc_id count like any other. A very
long text is a block of its own. Other columns are ignored whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import dropped, small_batches, written
from tidings.llm.token_files import breaks_at_spaces

BLOCK = 1 << 20
LIMIT = 200_000  # cuts or states that a task remembers before it starts afresh
B_BITS = 24  # an id pair is a long: A's id above, B's id in the low bits


def byte_values() -> dict[str, int]:
    """The character that byte-level vocabularies write for a byte -> the byte: visible Latin-1 characters stand for themselves,
    the other bytes for U+0100 and on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after the other, and their lengths."""
    n = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


class ByteTokens:
    """Side A: a byte-level BPE of the tokenizers library, special tokens' strings taken as text."""

    GLUED = 32

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.cuts = breaks_at_spaces(json.loads(self.lib.to_str()))
        value = byte_values()
        self.bytes_of = {i: bytes(map(value.__getitem__, t)) for t, i in self.lib.get_vocab(with_added_tokens=False).items() if all(c in value for c in t)}
        every = [self.bytes_of.get(i, b"") for i in range(max(self.lib.get_vocab(with_added_tokens=True).values()) + 1)]
        self.size = np.array([len(b) for b in every], np.int64)
        self.begin, self.table = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(every), np.uint8)

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of space+part for each part, one after the other, and how many each has. Where cuts are safe, parts are encoded
        GLUED to a text and told apart by their bytes."""
        if self.cuts:
            glued = [" " + " ".join(parts[a : a + self.GLUED]) for a in range(0, len(parts), self.GLUED)]
            ids, _ = flat([e.ids for e in self.lib.encode_batch_fast(glued, add_special_tokens=False)])
            reach = np.cumsum(self.size[ids])
            stops = np.cumsum([len(p.encode()) + 1 for p in parts])
            ends = np.searchsorted(reach, stops)
            if len(reach) and reach[-1] == stops[-1] and (reach[ends] == stops).all():
                return ids, np.diff(ends + 1, prepend=0)
        # whole texts, or bytes that the vocabulary can't hold
        return flat([e.ids for e in self.lib.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)])

    def text(self, ids: np.ndarray) -> bytes:
        """The bytes of ids."""
        n = self.size[ids]
        return self.table[np.repeat(self.begin[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes()


class PieceTokens:
    """Side B: a sentencepiece model that puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size())]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.bytes_of = {i: bytes([int(p[3:5], 16)]) if self.lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat(self.lib.encode(parts, num_threads=1))


class Transducer:
    """Groups of token sequences of both sides over the same bytes. Many sequences are walked at once, a token of each in a step;
    what is long beyond the others is finished alone."""

    FEW = 24  # as few walks are not worth numpy's calls

    def __init__(self, a: dict[int, bytes], b: dict[int, bytes]):
        self.bytes_of = (a, b)
        self.forget()

    def forget(self) -> None:
        self.number = {(0, b""): 0}  # (side whose token comes next, bytes that the other leads by) -> state; in 0 both sides have ended together
        self.states = [(0, b"")]
        self.moves: dict[int, int] = {}  # state and token as one number -> state after it
        self.keys, self.to, self.side = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int8)  # the same, sorted; side of each state

    def move(self, key: int) -> int:
        """The state after the next token: of A where nothing dangles, else of the side that lags. -1: the bytes differ."""
        (side, rest), own = self.states[key >> B_BITS], None
        own = self.bytes_of[side].get(key & ((1 << B_BITS) - 1))
        if not own:
            after = None
        elif rest.startswith(own):
            after = (side if len(own) < len(rest) else 0, rest[len(own) :])
        else:
            after = (1 - side, own[len(rest) :]) if own.startswith(rest) else None
        to = -1
        if after is not None:
            to = self.number.setdefault(after, len(self.states))
            if to == len(self.states):
                self.states.append(after)
        self.moves[key] = to
        return to

    def moved(self, keys: np.ndarray) -> np.ndarray:
        """move() of many; what is remembered is looked up."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        fresh = np.unique(keys[self.keys[at] != keys] if len(self.keys) else keys)
        if not len(fresh):
            return self.to[at]
        for key in fresh.tolist():
            if key not in self.moves:
                self.move(key)
        keys_, to = (np.fromiter(x, np.int64, len(self.moves)) for x in (self.moves.keys(), self.moves.values()))
        order = np.argsort(keys_)
        self.keys, self.to, self.side = keys_[order], to[order], np.array([s for s, _ in self.states], np.int8)
        return self.to[np.searchsorted(self.keys, keys)]

    def groups(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]):
        """For pairs of sequences (ids one after the other, their numbers): which pairs fit, and of all groups of these, in order, the pair and where
        its ids end in a and b."""
        if len(self.states) > LIMIT:
            self.forget()
        flat = [np.r_[ids, 0] for ids, _ in (a, b)]  # one more, for sides that have ended
        stop = [np.cumsum(n) for _, n in (a, b)]
        i, j = stop[0] - a[1], stop[1] - b[1]
        state, bad = np.zeros(len(i), np.int64), np.zeros(len(i), bool)
        live, out = np.arange(len(i)), []
        while True:
            live = live[(i[live] < stop[0][live]) | (j[live] < stop[1][live])]
            if len(live) < max(1, self.FEW):
                break
            now = state[live]
            of_b = self.side[now] == 1
            ended = np.where(of_b, j[live] >= stop[1][live], i[live] >= stop[0][live])
            bad[live[ended]] = True
            live, now, of_b = live[~ended], now[~ended], of_b[~ended]
            to = self.moved((now << B_BITS) + np.where(of_b, flat[1][j[live]], flat[0][i[live]]))
            i[live] += ~of_b
            j[live] += of_b
            state[live] = to
            bad[live[to < 0]] = True
            closed = live[to == 0]
            out.append((closed, i[closed], j[closed]))
            live = live[to >= 0]
        for k in live.tolist():
            rest = self.finished(k, flat, i[k], j[k], int(stop[0][k]), int(stop[1][k]), int(state[k]))
            bad[k] = rest is None
            state[k] = 0
            if rest:
                x, y = zip(*rest)
                out.append((np.full(len(x), k), np.array(x), np.array(y)))
        bad |= state != 0
        pair, x, y = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3))
        order = np.lexsort((x, pair))
        order = order[~bad[pair[order]]]
        return ~bad, pair[order], x[order], y[order]

    def finished(self, k, flat, i, j, i_stop, j_stop, state):
        """One pair's groups from a state on: their ends, or None where the bytes differ."""
        a, b = flat[0][i:i_stop].tolist(), flat[1][j:j_stop].tolist()
        x = y = 0
        out, moves, states = [], self.moves, self.states
        while x < len(a) or y < len(b):
            if states[state][0]:
                if y == len(b):
                    return None
                key = (state << B_BITS) + b[y]
                y += 1
            else:
                if x == len(a):
                    return None
                key = (state << B_BITS) + a[x]
                x += 1
            to = moves.get(key)
            state = self.move(key) if to is None else to
            if state <= 0:
                if state:
                    return None
                out.append((i + x, j + y))
        return None if state else out


class Aligner:
    """Texts to cuts, and what each cut that a task has met holds: number of A ids (-1: the bytes differ), of B ids, of groups, its
    groups as text, its links as id pairs."""

    CUT = re.compile(r"(?<=\S) (?=\S)")
    UNSAFE = re.compile(r"\A | \Z|\s | \s")

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.whole = not (self.a.cuts and self.b.cuts)
        self.walk = Transducer(self.a.bytes_of, self.b.bytes_of)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.shown: list[bytes] = []
        self.counts = array("i")  # three numbers a cut
        self.links, self.reach = array("q"), array("q", [0])  # the links of all cuts, and where each one's end
        self.known: dict = {}  # a group's link, or its ids -> its text

    def cuts(self, text: str) -> list[str]:
        if self.whole:
            return [text]
        return text.split(" ") if self.UNSAFE.search(text) is None else self.CUT.split(text)

    def learn(self, parts: list[str]) -> None:
        for first in range(0, len(parts), 8192):
            self.learned(parts[first : first + 8192])

    def learned(self, some: list[str]) -> None:
        (a, n_a), (b, n_b) = self.a.encode(some), self.b.encode(some)
        fits, pair, x, y = self.walk.groups((a, n_a), (b, n_b))
        if self.a.text(a) != (" " + " ".join(some)).encode():  # some part lost bytes: which?
            ends = np.cumsum(n_a).tolist()
            lost = np.array([self.a.text(a[i:j]) != b" " + p.encode() for i, j, p in zip([0, *ends], ends, some)])
            keep = ~lost[pair]
            fits, pair, x, y = fits & ~lost, pair[keep], x[keep], y[keep]
        n = np.bincount(pair, minlength=len(some))
        links = (a[x - 1] << B_BITS) + b[y - 1]
        self.links.frombytes(links.tobytes())
        self.reach.frombytes((self.reach[-1] + np.cumsum(n)).tobytes())
        shown, stops = self.texts(a, b, x, y, links, pair, n_a, n_b), np.cumsum(n).tolist()
        numbers = np.stack([np.where(fits, n_a, -1), np.where(fits, n_b, 0), n], axis=1).astype(np.int32)
        self.counts.frombytes(numbers.tobytes())
        self.number.update(zip(some, range(len(self.shown), len(self.shown) + len(some))))
        self.shown += [b";".join(shown[p:q]) for p, q in zip([0, *stops], stops)]

    def texts(self, a, b, x, y, links, pair, n_a, n_b) -> list[bytes]:
        """The text of each group: it begins where the one before it in its pair ends."""
        opens = np.r_[True, pair[1:] != pair[:-1]][: len(pair)]
        from_a, from_b = (np.where(opens, (np.cumsum(m) - m)[pair], np.r_[0, end[:-1]][: len(end)]) for m, end in ((n_a, x), (n_b, y)))
        single = (x - from_a == 1) & (y - from_b == 1)  # most groups: an id of either side, which the link names
        if len(self.known) > LIMIT // 4:
            self.known.clear()
        known, out = self.known, np.empty(len(pair), object)
        distinct, place = np.unique(links[single], return_inverse=True)
        names = np.empty(len(distinct), object)
        for k, link in enumerate(distinct.tolist()):
            text = known.get(link)
            if text is None:
                text = known[link] = b"%d|%d" % (link >> B_BITS, link & ((1 << B_BITS) - 1))
            names[k] = text
        out[single] = names[place]
        rest = np.flatnonzero(~single)
        left, right = a.tolist(), b.tolist()
        for k, i, j, p, q in zip(rest.tolist(), from_a[rest].tolist(), x[rest].tolist(), from_b[rest].tolist(), y[rest].tolist()):
            key = (*left[i:j], -1, *right[p:q])
            text = known.get(key)
            if text is None:
                text = known[key] = b"|".join([b",".join([b"%d" % v for v in side]) for side in (left[i:j], right[p:q])])
            out[k] = text
        return out.tolist()


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    key = (a_path, b_path)
    if key not in _aligners:
        _aligners[key] = Aligner(a_path, b_path)
    return _aligners[key]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


#: A block: its documents (doc_id, n_a, n_b, n_groups, sha), for each document how many cuts it has, cuts of all documents as numbers
#: (little-endian 32 bits, as are the next two), for each distinct cut how many links it has, those links as places in pairs, pairs, and how
#: often the block has each.
BLOCKS = "block long, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,groups_sha256:string>>, lengths binary, cuts binary, link_counts binary, links binary, pairs array<long>, times array<long>"


class Block:
    def __init__(self):
        self.docs, self.lengths, self.cuts, self.size = [], [], [], 0

    def add(self, doc_id, parts: list[str], size: int, align: Aligner) -> None:
        """A document of these cuts (none: no tokens)."""
        self.size += size
        cuts = np.fromiter(map(align.number.__getitem__, parts), "<u4", len(parts))
        counts = np.frombuffer(align.counts, np.int32).reshape(-1, 3)[cuts]
        if not len(cuts) or (counts[:, 0] < 0).any():
            self.docs.append((doc_id, 0, 0, 0, ""))
            self.lengths.append(0)
            return
        digest = hashlib.sha256(b";".join(map(align.shown.__getitem__, cuts.tolist()))).hexdigest()
        self.docs.append((doc_id, *counts.sum(axis=0, dtype=np.int64).tolist(), digest))
        self.lengths.append(len(cuts))
        self.cuts.append(cuts)

    def row(self, block: int, align: Aligner) -> pa.RecordBatch:
        distinct, cuts = np.unique(np.concatenate([np.zeros(0, "<u4"), *self.cuts]), return_inverse=True)
        reach = np.frombuffer(align.reach, np.int64)
        begin, count = reach[distinct], np.diff(reach)[distinct]
        links = np.frombuffer(align.links, np.int64)[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())]
        pairs, place = np.unique(links, return_inverse=True)
        times = np.bincount(place, np.repeat(np.bincount(cuts, minlength=len(distinct)), count), len(pairs)).astype(np.int64)
        names = ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
        docs = [dict(zip(names, d)) for d in self.docs]
        raw = [np.array(self.lengths, "<u4").tobytes(), cuts.astype("<u4").tobytes(), count.astype("<u4").tobytes(), place.astype("<u4").tobytes()]
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in names[:4]] + [(names[4], pa.string())]))
        values = [pa.array([block], pa.int64()), pa.array([docs], kind), *[pa.array([x], pa.binary()) for x in raw], pa.array([pairs], pa.list_(pa.int64())), pa.array([times], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(values, names=["block", "docs", "lengths", "cuts", "link_counts", "links", "pairs", "times"])


def blocks(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    def run(batches):
        align, number, own = aligner(*paths), TaskContext.get().partitionId() << 32, Block()
        for b in batches:
            ids, found = b.column(0).to_pylist(), b.column(1).to_pylist()
            first = 0
            while first < len(found):
                last, size = first, 0
                while last < len(found) and (last == first or size < BLOCK):
                    size += len(found[last] or "") + 16
                    last += 1
                if own.docs and own.size + size > BLOCK:
                    yield own.row(number, align)
                    number, own = number + 1, Block()
                if len(align.shown) > LIMIT and not own.docs:
                    align.forget()
                parts = [align.cuts(t) if t else [] for t in found[first:last]]
                fresh = set()
                for p in parts:
                    fresh.update(p)
                align.learn(list(fresh.difference(align.number)))
                for doc, own_parts, text in zip(ids[first:last], parts, found[first:last]):
                    own.add(doc, own_parts, len(text or "") + 16, align)
                first = last
        if own.docs:
            yield own.row(number, align)
        align.forget()  # the worker goes on to other stages

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS)


def pair_counts(every: DataFrame) -> DataFrame:
    """pair, n (links of the whole corpus that hold it), best (whether no pair of its B id has more)."""
    each = every.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = written(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")), "pair-counts")
    b_id = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    most = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    with small_batches(docs.sparkSession):
        every = written(blocks(docs, paths or default_paths()), "align-blocks")
        counts = written(pair_counts(every), "align-counts")
        own = every.select("block", F.posexplode("pairs").alias("k", "pair"))
        told = own.join(counts, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", "n", "best"))).alias("told"))
        told = written(told.select("block", F.col("told.n").alias("n"), F.col("told.best").alias("best")), "align-told")
        out = written(every.join(told, "block", "left").mapInArrow(finished, RESULT), "aligned")
        for t in (every, counts, told):
            dropped(t)
    return out


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def finished(batches):
    def per_part(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums of consecutive stretches of values."""
        ends = np.cumsum(lengths)
        sums = np.r_[0, np.cumsum(values)]
        return sums[ends] - sums[ends - lengths]

    at = ("docs", "lengths", "cuts", "link_counts", "links", "n", "best")
    for b in batches:
        columns = {k: b.column(b.schema.get_field_index(k)) for k in at}
        for row in range(b.num_rows):
            lengths, cuts, count, links = (np.frombuffer(columns[k][row].as_py(), "<u4").astype(np.int64) for k in at[1:5])
            n, best = (np.array(columns[k][row].as_py() or [], np.int64) for k in at[5:])
            docs = pa.RecordBatch.from_struct_array(columns["docs"][row].values)
            n_links, n_best, count_sum = (per_part(per_part(x, count)[cuts], lengths) for x in (np.ones(len(links), np.int64), best[links], n[links]))
            more = [pa.array(x, pa.int64()) for x in (n_links, n_best, count_sum)]
            yield pa.RecordBatch.from_arrays([*docs.columns[:4], *more, docs.column(4)], names=[x.split()[0] for x in RESULT.split(", ")])
