"""Operator 1: language-model scores by logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.llm.common import without
from brinewell.session import cut

#: Most words with a code of their own (others are spelled), nodes of the code tree that contexts predict, and characters worked on at once.
CODED, NODES, AT_ONCE = 1 << 18, 1 << 13, 300_000
#: Training tokens that are gathered before they are counted.
HELD = 500_000
#: Words that name the language of a text (function words), and classes of previous words.
FUNCTION, CLASSES = 64, 1 << 8
#: Tokens of a text's first block and most of a block, each twice as long as the one before; the step of the refinements between them, most texts that the fit of the first weights begins with, and characters of them all after which no more are taken.
FIRST, BLOCK, STEP, FIT_DOCS, FIT_CHARS = 8, 256, 0.3, 400, 1_500_000
#: Most passes over the training texts that fit the first weights, and the move of their logits by a step after which no other follows.
PASSES, NEAR = 8, 0.1
#: Steps of a path that are counted by their contexts before they are predicted, in that fit: the nodes so high up are the first 1 << TOP at most.
TOP = 6
#: Decisions that a word context must have seen to weigh as much as the node alone, and what a letter context counts as seen of either bit.
PRIOR, LETTER_PRIOR = 4.0, 0.2
#: Tokens of a very long text that are worked on at once, after its first blocks.
STRETCH = 40_000 // BLOCK * BLOCK
#: Partial tables that one group adds up.
FAN_IN = 64
END = b"\n"
#: Letters before a letter, and bits of their hash; slots of each predictor: word codes by node, by last function word, by class of the previous word; letters.
LETTERS = ((1, 8), (2, 12), (3, 13), (4, 14), (6, 14))
SLOTS = (NODES, FUNCTION * NODES, CLASSES * NODES, *(256 << bits for _, bits in LETTERS))
#: Sets of mixing weights: by depth in the code tree; by the letter contexts that training has met.
GATES, LETTER_GATES = 4, len(LETTERS) + 1
BASE = np.concatenate([[0], np.cumsum(SLOTS)])
SEGMENT = 1 << 14
#: Gate of each node: a few levels of the code tree together.
DEPTHS = np.minimum(GATES - 1, np.log2(np.arange(1, NODES + 1)).astype(np.int32) // 3)
#: Rows of a batch that are taken out of it at once.
SLICE = 256


def tokens_of(text: str | None) -> list[bytes]:
    """The words between ASCII white space, A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Code:
    """A binary code of the most frequent words, the end of text and `spelled` (any other word)."""

    def __init__(self, words: list[bytes], counts: list[int], spelled: int):
        self.index = {w: i for i, w in enumerate(words)}
        self.counts = np.array(counts, np.int64)
        once = self.counts == 1
        # of the words met once, half are spelled in training: what stands there once stands for what is new later
        self.shy = np.append(once & np.array([zlib.crc32(w) & 1 for w in words], bool), False)
        weight = np.array([*np.where(once, 0.5, self.counts), max(1, spelled + once.sum() / 2)], np.float64)
        self.spelled = len(words)
        heap = [(float(w), i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        left, right, mass = {}, {}, dict(enumerate(weight.tolist()))
        nxt = len(weight)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            left[nxt], right[nxt], mass[nxt] = i, j, a + b
            heapq.heappush(heap, (a + b, nxt))
            nxt += 1
        paths: list[list[int]] = [[] for _ in weight]
        self.rest = np.zeros(len(weight))
        level, number = [(nxt - 1, [], 0.0)], 0
        while level:  # nodes are numbered level by level, so a path's first steps are the predicted ones
            below = []
            for node, path, rest in level:
                if node not in left:
                    paths[node], self.rest[node] = path, rest
                    continue
                for bit, child in ((0, left[node]), (1, right[node])):
                    if number < NODES:
                        below.append((child, [*path, 2 * number + bit], rest))
                    else:
                        below.append((child, path, rest - np.log2(mass[child] / mass[node])))
                number += 1
            level = below
        self.length = np.array([len(p) for p in paths], np.int32)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1].astype(np.int64)
        self.steps = np.array([s for p in paths for s in p], np.int32)
        self.letter_steps, self.letter_start, self.letter_length = _letter_code(words)


def _letter_code(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A binary code of the 256 letters by their share in the words, the blank once a word: steps (node, bit), and each letter's first and number of them."""
    share = np.bincount(np.frombuffer(b" ".join(words) + bytes(range(256)), np.uint8), minlength=256)
    heap = [(int(n), i, i) for i, n in enumerate(share)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, _, x), (b, i, y) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a + b, i, (x, y)))
    paths, todo, node = [[] for _ in range(256)], [(heap[0][2], [])], 0
    while todo:
        at, path = todo.pop()
        if isinstance(at, int):
            paths[at] = path
            continue
        todo += [(child, [*path, 2 * node + bit]) for bit, child in enumerate(at)]
        node += 1
    length = np.array([len(p) for p in paths], np.int64)
    return np.array([s for p in paths for s in p], np.int32), np.cumsum(length) - length, length


def block_of(within: np.ndarray) -> np.ndarray:
    """The block of each place in a text: of FIRST tokens, twice as many, and so on up to BLOCK."""
    ends = np.cumsum(FIRST << np.arange((BLOCK // FIRST).bit_length() - 1))
    return np.where(within < ends[-1], np.searchsorted(ends, within, side="right"), len(ends) + (within - ends[-1]) // BLOCK)


class Tokens:
    """The tokens of a batch of texts as ids, with the last function word and the class of the word before each.

    place: of the first token, for a stretch of one text, which `carry` (the id
    of the token before, and of the last function word) ties to what was before.
    ended: whether the end of the text follows.
    """

    def __init__(self, code: Code, texts: list[list[bytes]], learn: bool = False, place: int = 0, carry: tuple[int, int] | None = None, ended: bool = True):
        n = np.array([len(t) + ended for t in texts])
        flat: list[bytes] = []
        for t in texts:
            flat += t
            if ended:
                flat.append(END)
        ids = np.fromiter(map(code.index.get, flat, repeat(code.spelled)), np.int64, len(flat))
        if learn:
            ids = np.where(code.shy[ids], code.spelled, ids)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        doc = np.repeat(np.arange(len(texts)), n)
        at = np.arange(len(flat))
        self.within = at - first[doc] + place
        before = np.concatenate([[0], ids[:-1]])
        before[first] = carry[0] if carry else CLASSES - 1
        self.klass = np.where(before < CLASSES // 2, before, CLASSES // 2 + before % (CLASSES // 2)).astype(np.int32)
        seen = np.where(before < FUNCTION - 1, at, -1)
        seen = np.maximum.accumulate(seen)
        word = np.where(seen >= first[doc], before[np.maximum(seen, 0)], carry[1] if carry else FUNCTION - 1)
        self.carry = (int(ids[-1]), int(ids[-1] if ids[-1] < FUNCTION - 1 else word[-1])) if len(ids) else carry
        self.word, self.doc_of = word.astype(np.int32), doc.astype(np.int32)
        self.ids, self.flat, self.n = ids, flat, n

    def letters(self, code: Code, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets lat and lbit, the decisions of the letters of spelled words, each with a blank after it; those words in the given order, and the decisions of each."""
        spelled = order[self.ids[order] == code.spelled]
        self.lat, self.lbit, size = letter_decisions(code, [self.flat[i] for i in spelled.tolist()])
        return spelled, size


def letter_decisions(code: Code, words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The slots (of each context) and bits of the letters of some words, each with a blank after it, and the decisions of each word."""
    raw = np.frombuffer(b"".join(w + b" " for w in words), np.uint8).astype(np.int64)
    lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    place = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    size = code.letter_length[raw]
    step = code.letter_steps[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - code.letter_start[raw], size)]
    node, bit = step >> 1, (step & 1).astype(np.int8)
    slots, past, k = [], np.zeros(len(raw), np.int64), 0
    for (letters, bits), base in zip(LETTERS, BASE[3:].tolist(), strict=False):
        while k < letters:
            k += 1
            past = past * 0x2F0B4C47 + np.where(place >= k, np.concatenate([np.zeros(min(k, len(raw)), np.int64), raw[:-k]]), 32) + 1
        context = (past * 0x5851F42D4C957F2D >> 40) & ((1 << bits) - 1) if letters > 1 else past - 1
        at = np.repeat((context * 256 + base).astype(np.int32), size)
        at += node
        slots.append(at)
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(lengths)])]
    return slots, bit, np.diff(ends)


class Bits(Tokens):
    """The binary decisions of a batch of texts, ordered by block within the text, then by text; edges and ledges: where the blocks of word codes and of letters start, and the end."""

    def __init__(self, code: Code, texts: list[list[bytes]], learn: bool = False, place: int = 0, carry: tuple[int, int] | None = None, ended: bool = True):
        super().__init__(code, texts, learn, place, carry, ended)
        blocks, doc = block_of(self.within), self.doc_of
        self.rest = np.bincount(doc, code.rest[self.ids], len(texts))
        o = np.argsort(blocks, kind="stable")
        ids = self.ids[o]
        size = code.length[ids]
        step = _steps(code, ids, size)
        node, self.bit = step >> 1, (step & 1).astype(np.int8)
        self.at = [node]
        for context, base in ((self.word, BASE[1]), (self.klass, BASE[2])):
            at = np.repeat(context[o] * np.int32(NODES) + np.int32(base), size)
            at += node
            self.at.append(at)
        self.doc = np.repeat(doc[o], size)
        self.row = np.repeat(doc[o] * np.int32(GATES), size)
        self.row += DEPTHS[node]
        self.edges = _edges(blocks[o], size)
        spelled, size = self.letters(code, o)
        self.ldoc = np.repeat(doc[spelled], size)
        self.ledges = _edges(blocks[spelled], size)


def _steps(code: Code, ids: np.ndarray, size: np.ndarray, skip: int = 0) -> np.ndarray:
    """The steps of the ids' paths, one path after another; size of each, after the first `skip`."""
    step = np.repeat((code.start[ids] + skip - np.cumsum(size) + size).astype(np.int32), size)
    step += np.arange(len(step), dtype=np.int32)
    return np.take(code.steps, step)


def _edges(blocks: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where the decisions of each block start, and the end; from the blocks of tokens in ascending order, and the decisions of each."""
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    return np.unique(np.append(ends[:-1][np.concatenate([[True], blocks[1:] != blocks[:-1]])] if len(blocks) else 0, ends[-1]))


class Counts:
    """Zeros and ones that each slot met (slot s: at 2 s and 2 s + 1). Pairs of context and token are gathered, and each distinct one's path is added once."""

    def __init__(self, code: Code):
        self.code, self.table = code, np.zeros(2 * int(BASE[-1]), np.uint32)  # a task meets fewer
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, t: Tokens) -> None:
        t.letters(self.code, np.arange(len(t.ids)))
        for at in t.lat:
            slot = 2 * at.astype(np.int64)
            slot += t.lbit
            np.add.at(self.table, slot, np.uint32(1))
        self.waiting.append((t.word, t.klass, t.ids))
        self.held += len(t.ids)
        if self.held >= HELD:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        word, klass, ids = (np.concatenate(c) for c in zip(*self.waiting, strict=True))
        self.waiting, self.held = [], 0
        width = len(self.code.length)
        for context, base in ((np.zeros(1, np.int64), 0), (word, int(BASE[1])), (klass, int(BASE[2]))):
            pairs, times = np.unique(context.astype(np.int64) * width + ids, return_counts=True)
            for k in range(0, len(pairs), AT_ONCE // 4):
                p, n = pairs[k : k + AT_ONCE // 4], times[k : k + AT_ONCE // 4]
                size = self.code.length[p % width]
                slot = np.repeat(2 * (p // width * NODES + base), size)
                slot += _steps(self.code, p % width, size)
                np.add.at(self.table, slot, np.repeat(n.astype(np.uint32), size))


def _start_weights(gates: int, inputs: int) -> np.ndarray:
    w = np.full((gates, inputs + 1), 1.0 / inputs, np.float32)
    w[:, -1] = 0
    return w


def _mixed(logit: np.ndarray, at: list[np.ndarray], bit: np.ndarray, doc: np.ndarray, edges: np.ndarray, row: np.ndarray | None, docs: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits that each text costs, and its weights at the end.

    Each text begins with the start weights. A decision is predicted with the
    weights of its row, a gate of its text (by default, how many of its contexts
    training has met); after every block of the text, they move along the
    block's mean gradient of the cost.
    """
    k, gates = len(at), len(start)
    weights = np.tile(start.T, docs)
    cost = np.zeros(docs)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        x = np.empty((k, hi - lo), np.float32)
        for i in range(k):
            np.take(logit, at[i][lo:hi], out=x[i], mode="clip")
        r = row[lo:hi] if row is not None else doc[lo:hi] * np.int32(gates) + (x != 0).sum(0, dtype=np.int32)
        r = r.astype(np.intp)
        sign = 2 * bit[lo:hi].astype(np.float32) - 1
        z = np.take(weights[k], r)
        for i in range(k):
            z += np.take(weights[i], r) * x[i]
        z *= -sign
        e = np.exp(np.clip(z, -20, 20, out=z), out=z)
        odds = 1 + e
        cost += np.bincount(doc[lo:hi], np.log(odds), docs)
        miss = sign * (e / odds)
        pull = STEP / (np.bincount(r, minlength=docs * gates) + 64.0)
        for i in range(k + 1):
            weights[i] += (pull * np.bincount(r, miss * x[i] if i < k else miss, docs * gates)).astype(np.float32)
    return cost * np.log2(np.e), weights.T.reshape(docs, gates, k + 1)


def _fitted(x: np.ndarray, bit: np.ndarray, gate: np.ndarray, gates: int) -> np.ndarray:
    """The weights of each gate that cost the sample least: logistic regression on the logits x by Newton steps, held near the even weights."""
    k = x.shape[1]
    out = _start_weights(gates, k).astype(np.float64)
    for g in range(gates):
        b = bit[gate == g]
        xs = np.column_stack([x[gate == g].astype(np.float64), np.ones(len(b))])
        even, w = out[g].copy(), out[g]
        for _ in range(8 if len(b) else 0):
            p = 1 / (1 + np.exp(-np.clip(xs @ w, -20, 20)))
            slope = xs.T @ (p - b) + 10 * (w - even)
            w -= np.clip(np.linalg.solve((xs * (p * (1 - p))[:, None]).T @ xs + 10 * np.eye(k + 1), slope), -1, 1)
    return out.astype(np.float32)


def slots_of(b: Bits) -> np.ndarray:
    """The slots that some texts' decisions touch, each once."""
    return np.unique(np.concatenate([*b.at, *b.lat]))


def left_out(b: Bits, copies: int, slots: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logits of a training text's decisions (by word, by letter) from the counts `seen` of `slots` without all copies of the text, kept to compare one_out with."""
    u = slots_of(b)
    rest = seen[np.searchsorted(slots, u)].astype(np.float64)
    for at, bit in [(a, b.bit) for a in b.at] + [(a, b.lbit) for a in b.lat]:
        np.subtract.at(rest, (np.searchsorted(u, at), bit), copies)
    z, o = np.maximum(rest, 0).T
    node = (o + 0.4) / (z + o + 0.8)
    p = node.copy()
    context = (u >= BASE[1]) & (u < BASE[3])
    parent = np.searchsorted(u, (u[context] - BASE[1]) % NODES)  # all words' tables are whole rows of nodes
    p[context] = (o[context] + PRIOR * node[parent]) / (z[context] + o[context] + PRIOR)
    logit = np.where(u < BASE[3], np.log(p / (1 - p)), np.log((o + LETTER_PRIOR) / (z + LETTER_PRIOR))).astype(np.float32)
    x, y = ([logit[np.searchsorted(u, a)] for a in at] for at in (b.at, b.lat))
    return np.stack(x, 1), np.stack(y, 1)


def one_out(b: Bits, slots: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logits of a training text's decisions (by word, by letter) as fit_all has them: from contexts that have not met the decision itself."""

    def met(at: np.ndarray, bit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        z, o = seen[np.searchsorted(slots, at)].astype(np.float64).T
        return (z, o) if bit is None else (np.maximum(z - 1 + bit, 0), np.maximum(o - bit, 0))

    z, o = met(b.at[0], None)
    node = (o + 0.4) / (z + o + 0.8)
    p = [node] + [(o + PRIOR * node) / (z + o + PRIOR) for z, o in (met(at, b.bit) for at in b.at[1:])]
    x, y = [np.log(q / (1 - q)) for q in p], [np.log((o + LETTER_PRIOR) / (z + LETTER_PRIOR)) for z, o in (met(at, b.lbit) for at in b.lat)]
    return np.stack(x, 1).astype(np.float32), np.stack(y, 1).astype(np.float32)


def fit_start(sample: list[tuple[Bits, int]], slots: np.ndarray, seen: np.ndarray) -> list[np.ndarray]:
    """Where fit_all begins: weights fitted on a bounded sample of (text, copies); even ones without any."""
    if not sample:
        return [_start_weights(GATES, 3), _start_weights(LETTER_GATES, len(LETTERS))]
    words, letters = zip(*[one_out(b, slots, seen) for b, _ in sample], strict=True)
    x, y = np.concatenate(words), np.concatenate(letters)
    bit, row, lbit = (np.concatenate([getattr(b, c) for b, _ in sample]) for c in ("bit", "row", "lbit"))
    return [_fitted(x, bit, row % GATES, GATES), _fitted(y, lbit, (y != 0).sum(1), LETTER_GATES)]


def fit_sample(train: DataFrame) -> list[tuple[str, int]]:
    """(text, copies) of the texts that fit_start begins with: the FIT_DOCS distinct training texts with the least hashes, up to the one that reaches FIT_CHARS characters; whole texts."""
    hashed = train.select(F.coalesce("t", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    first = hashed.groupBy("h").agg(F.max(F.length("t")).alias("size"), F.count(F.lit(1)).alias("copies")).orderBy("h").limit(FIT_DOCS).collect()
    taken, size = {}, 0
    for r in first:
        if size >= FIT_CHARS:
            break
        taken[r["h"]] = r["copies"]
        size += r["size"]
    if not taken:
        return []
    texts = hashed.where(F.col("h").isin(list(taken))).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").collect()
    return [(r["t"], taken[r["h"]]) for r in texts]


class LeftOut:
    """The logits of training decisions, each context's without the decision itself: made from the counts by the process that first asks for them."""

    def __init__(self, blobs: list[tuple[int, bytes]]):
        self.blobs, self._made = blobs, None

    def tables(self) -> np.ndarray:
        """slot_logits without one zero, then without one one; a decision of slot s and its bit is at bit * BASE[-1] + s."""
        if self._made is None:
            none = np.empty(0, np.int64)
            self._made, self.blobs = np.concatenate([slot_logits(iter(self.blobs), none, bit)[0] for bit in (0, 1)]), None
        return self._made


class Pulls:
    """Slope and curvature of the cost of training decisions at given weights, by gate: what a Newton step sums up."""

    def __init__(self, code: Code, tables: np.ndarray, start: list[np.ndarray]):
        self.code, self.tables, self.start = code, tables, start
        self.sums = [np.zeros((len(w), w.shape[1] + 1, w.shape[1])) for w in start]  # by gate, the curvature's rows, then the slope
        self.top = np.zeros(FUNCTION * CLASSES << TOP + 1, np.int64)  # by contexts and step: the first steps of all paths, which many share
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def _add(self, kind: int, at: list[np.ndarray], bit: np.ndarray, gate: np.ndarray | None, times: np.ndarray) -> None:
        k, out = len(at), self.sums[kind]
        x = np.empty((k + 1, len(bit)), np.float32)
        x[k] = 1
        own = bit.astype(np.int32) * np.int32(BASE[-1])
        for i in range(k):
            np.take(self.tables, at[i] + own, out=x[i], mode="clip")
        gate = (x[:k] != 0).sum(0, dtype=np.int8) if gate is None else gate
        bit, times = bit.astype(np.float32), times.astype(np.float32)
        for g in range(len(out)):
            here = np.flatnonzero(gate == g)
            xs, n = np.take(x, here, 1), times[here]
            p = np.clip(self.start[kind][g].astype(np.float32) @ xs, -20, 20)
            np.negative(p, out=p)
            np.exp(p, out=p)
            p += 1
            np.reciprocal(p, out=p)
            out[g, -1] += xs @ (n * (p - bit[here]))
            n *= p
            n *= 1 - p
            out[g, :-1] += (xs * n) @ xs.T

    def add(self, t: Tokens) -> None:
        """The word codes of some texts; each distinct pair of contexts with a word once, with its number."""
        self.waiting.append((t.word.astype(np.int64) * CLASSES + t.klass) * len(self.code.length) + t.ids)
        self.held += len(t.ids)
        if self.held >= HELD:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        met, times = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting, self.held = [], 0
        width = len(self.code.length)
        for k in range(0, len(met), AT_ONCE // 8):
            contexts, ids = np.divmod(met[k : k + AT_ONCE // 8], width)
            n, length = times[k : k + AT_ONCE // 8], self.code.length[ids]
            size = np.minimum(length, TOP)
            np.add.at(self.top, np.repeat(contexts << TOP + 1, size) + _steps(self.code, ids, size), np.repeat(n, size))
            size = length - size
            self._word(np.repeat(contexts, size), _steps(self.code, ids, size, TOP), np.repeat(n, size))

    def _word(self, contexts: np.ndarray, step: np.ndarray, times: np.ndarray) -> None:
        node = step >> 1
        word, klass = np.divmod(contexts, CLASSES)
        at = [node, *((c * NODES + base).astype(np.int32) + node for c, base in ((word, BASE[1]), (klass, BASE[2])))]
        self._add(0, at, step & 1, DEPTHS[node], times)

    def spell(self, words: list[bytes], times: list[int]) -> None:
        """The letters of spelled words, and how often each is spelled."""
        lat, bit, size = letter_decisions(self.code, words)
        self._add(1, lat, bit, None, np.repeat(np.array(times, np.int64), size))

    def rows(self) -> pa.RecordBatch:
        self.flush()
        met = np.flatnonzero(self.top)
        for k in range(0, len(met), AT_ONCE):
            contexts, step = np.divmod(met[k : k + AT_ONCE], 2 << TOP)
            self._word(contexts, step.astype(np.int32), self.top[met[k : k + AT_ONCE]])
        v = np.concatenate([s.ravel() for s in self.sums])
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["place", "v"])


def pulls(train: DataFrame, counts: DataFrame, code, left, start: list[np.ndarray]) -> list[np.ndarray]:
    """Pulls.sums over every decision of all training texts: word codes from the texts, letters from the counts of their words."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pulls(code.value, left.value.tables(), start)
        for b in batches:
            for _, texts in _parts(b.column(0)):
                for t in stretches(code.value, texts, True, Tokens):
                    p.add(t)
        yield p.rows()

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = code.value
        p = Pulls(c, left.value.tables(), start)
        part, times, size = [], [], 0
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                i = c.index.get(w, c.spelled)
                if i == c.spelled or c.shy[i]:
                    part.append(w)
                    times.append(n)
                    size += len(w) + 1
                    if size >= AT_ONCE // 8:
                        p.spell(part, times)
                        part, times, size = [], [], 0
        if part:
            p.spell(part, times)
        yield p.rows()

    schema = "place int, v double"
    each = train.select("t").mapInArrow(words, schema).union(counts.select("token", "c").mapInArrow(letters, schema))
    v, out, at = {r["place"]: r["v"] for r in each.groupBy("place").agg(F.sum("v").alias("v")).collect()}, [], 0
    for w in start:
        n = w.size + w.size * w.shape[1]
        out.append(np.array([v.get(at + i, 0.0) for i in range(n)]).reshape(len(w), w.shape[1] + 1, w.shape[1]))
        at += n
    return out


def fit_all(train: DataFrame, counts: DataFrame, code, blobs: list[tuple[int, bytes]], start: list[np.ndarray]) -> list[np.ndarray]:
    """The weights that every text begins with: logistic regression by Newton steps over all decisions of all training texts, each predicted from contexts that have not met it, held near the even weights.

    `start` is where the steps begin, no bound of the result: the cost is convex,
    and steps go on until one moves the logits of all decisions by less than NEAR
    (root of their mean square), after which about the square of that is left. A
    step that would move those of a gate by more than 1 is cut to that.
    """
    left = train.sparkSession.sparkContext.broadcast(LeftOut(blobs))
    at = [w.astype(np.float64) for w in start]
    for _ in range(PASSES):
        moved = weighed = 0.0
        for w, sums in zip(at, pulls(train, counts, code, left, at), strict=True):
            even = _start_weights(len(w), w.shape[1] - 1)
            for g in range(len(w)):
                curve, slope = sums[g, :-1], sums[g, -1] + 10 * (w[g] - even[g])
                step = np.linalg.solve(curve + 10 * np.eye(len(curve)), slope)
                far = step @ curve @ step
                w[g] -= step / max(1.0, np.sqrt(far / max(curve[-1, -1], 1.0)))
                moved, weighed = moved + far, weighed + curve[-1, -1]
        if moved <= NEAR**2 * weighed:
            break
    left.destroy()
    return [np.round(w, 3).astype(np.float32) for w in at]


def _scored(b: Bits, logit: np.ndarray, start: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The bits that each text's decisions cost, and its weights at the end."""
    a, wa = _mixed(logit, b.at, b.bit, b.doc, b.edges, b.row, len(b.n), start[0])
    s, ws = _mixed(logit, b.lat, b.lbit, b.ldoc, b.ledges, None, len(b.n), start[1])
    return a + s + b.rest, [wa, ws]


def stretches(code: Code, texts: list[list[bytes]], learn: bool = False, kind: type[Tokens] = Bits) -> Iterator[Tokens]:
    """The decisions (or tokens) of some texts; of a very long one alone, in stretches of whole blocks."""
    most = STRETCH + sum(FIRST << k for k in range((BLOCK // FIRST).bit_length() - 1))
    if len(texts) != 1 or len(texts[0]) <= most:
        yield kind(code, texts, learn)
        return
    words, at, carry = texts[0], 0, None
    while at < len(words):
        end = min(len(words), at + STRETCH if at else most)
        b = kind(code, [words[at:end]], learn, at, carry, end == len(words))
        yield b
        at, carry = end, b.carry


def text_bits(code: Code, logit: np.ndarray, start: list[np.ndarray], texts: list[list[bytes]]) -> tuple[list[Bits], np.ndarray]:
    """The decisions of some texts and the bits that each costs in all; a stretch goes on with the weights of the one before."""
    parts, cost = [], np.zeros(len(texts))
    for b in stretches(code, texts):
        c, ends = _scored(b, logit, start)
        cost += c
        if len(texts) == 1:
            start = [w[0] for w in ends]
        parts.append(Said(b))
    return parts, cost


class Said:
    """The tokens of some decisions: ids, words, and how many each text has."""

    def __init__(self, b: Bits):
        self.ids, self.flat, self.n = b.ids, b.flat, b.n


def _parts(column: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Texts as words, in parts of about AT_ONCE characters, with the place of each part's first."""
    part, size, first = [], 0, 0
    for i, t in enumerate(t for k in range(0, len(column), SLICE) for t in column.slice(k, SLICE).to_pylist()):
        part.append(tokens_of(t))
        size += len(t or "")
        if size >= AT_ONCE:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def token_counts(train: DataFrame) -> DataFrame:
    """(token, c) over all training texts, END once a text; counted within a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter[bytes] = Counter()
            c[END] = b.num_rows
            for k in range(0, b.num_rows, SLICE):
                for t in b.column(0).slice(k, SLICE).to_pylist():
                    c.update(tokens_of(t))
                if len(c) > 200_000 or k + SLICE >= b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["token", "c"])
                    c.clear()

    return train.select("t").mapInArrow(run, "token binary, c long").where("c > 0").groupBy("token").agg(F.sum("c").alias("c"))


def make_code(counts: DataFrame, total: int, most: int = CODED) -> Code:
    """The code of all words from the least count that at most `most` words reach; so many reach the driver."""
    bucket = F.floor(F.log2("c") * 64)
    sizes = sorted(((r["b"], r["n"]) for r in counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, have = None, 0
    for b, n in sizes:
        if have + n > most:
            break
        least, have = b, have + n
    rows = [] if least is None else [(bytes(r["token"]), r["c"]) for r in counts.where(bucket >= least).toLocalIterator()]
    rows = sorted(dict([*rows, (END, dict(rows).get(END, 1))]).items(), key=lambda r: (-r[1], r[0]))
    return Code([w for w, _ in rows], [c for _, c in rows], total - sum(c for _, c in rows))


def predictor_counts(train: DataFrame, code) -> DataFrame:
    """(segment, blob): zeros and ones that each slot of the predictors met, all training texts added up.

    A task sends its tables once, as the slots it met of each segment; FAN_IN of
    them at most are added in one group, level by level.
    """
    slots = int(BASE[-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        met = Counts(code.value)
        for b in batches:
            for _, texts in _parts(b.column(0)):
                for tokens in stretches(code.value, texts, True, Tokens):
                    met.add(tokens)
        met.flush()
        yield from _blobs(met.table, TaskContext.get().partitionId())

    def _blobs(table: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
        out = []
        for s in range(-(-slots // SEGMENT)):
            seg = table[2 * s * SEGMENT : 2 * (s + 1) * SEGMENT]
            i = np.flatnonzero(seg)
            if len(i):
                out.append((s, part, blob_of(i, seg[i])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], names=["segment", "part", "blob"])

    def add(table: pa.Table) -> pa.Table:
        got = np.zeros(2 * SEGMENT, np.int64)
        for blob in table["blob"].to_pylist():
            i, n = blob_values(blob)
            got[i] += n
        i = np.flatnonzero(got)
        return pa.table([table["segment"].slice(0, 1), pa.array([table["part"][0].as_py() // FAN_IN], pa.int64()), pa.array([blob_of(i, got[i])], pa.binary())], names=["segment", "part", "blob"])

    schema = "segment int, part long, blob binary"
    out = train.select("t").mapInArrow(count, schema)
    parts = train.rdd.getNumPartitions()
    while True:
        out = out.groupBy("segment", F.expr(f"part div {FAN_IN}")).applyInArrow(add, schema)
        if parts <= FAN_IN:
            return out
        parts = -(-parts // FAN_IN)


def blob_of(i: np.ndarray, n: np.ndarray) -> bytes:
    """Places and counts, most of which are small."""
    big = n >= 1 << 16
    return np.uint32(len(n) - big.sum()).tobytes() + i[~big].astype(np.uint16).tobytes() + n[~big].astype(np.uint16).tobytes() + i[big].astype(np.uint16).tobytes() + n[big].astype(np.int64).tobytes()


def blob_values(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    small = int(np.frombuffer(blob, np.uint32, 1)[0])
    big = (len(blob) - 4 - 4 * small) // 10
    at = 4 + 4 * small
    i = [np.frombuffer(blob, np.uint16, small, 4), np.frombuffer(blob, np.uint16, big, at)]
    n = [np.frombuffer(blob, np.uint16, small, 4 + 2 * small).astype(np.int64), np.frombuffer(blob[at + 2 * big :], np.int64)]
    return np.concatenate(i).astype(np.int64), np.concatenate(n)


def slot_logits(blobs: Iterator[tuple[int, bytes]], slots: np.ndarray, less: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The logit of a one in every slot, from its zeros and ones (0: never met); word contexts lean on the node alone where they saw little. And the zeros and ones of the given slots. less: the bit of which every context is to have met one less."""
    seen = np.zeros((len(slots), 2), np.int64)
    words, out = int(BASE[3]), np.zeros(int(BASE[-1]), np.float32)
    zeros, ones = np.zeros(words), np.zeros(words)
    for segment, blob in blobs:
        i, c = blob_values(blob)
        got = np.zeros(2 * SEGMENT)
        got[i] = c
        if less is not None:  # nodes keep theirs: a code is near even there, and what is left would tell the bit that is gone
            one = got[2 * max(0, NODES - segment * SEGMENT) + less :: 2]
            np.maximum(one - 1, 0, out=one)
        at, end = segment * SEGMENT, min((segment + 1) * SEGMENT, len(out))
        z, o = got[::2][: end - at], got[1::2][: end - at]
        lo, hi = np.searchsorted(slots, (at, end))
        seen[lo:hi] = got.reshape(-1, 2)[slots[lo:hi] - at]
        m = max(0, min(words, end) - at)
        zeros[at : at + m], ones[at : at + m] = z[:m], o[:m]
        out[at + m : end] = np.log((o[m:] + LETTER_PRIOR) / (z[m:] + LETTER_PRIOR))
    p = (ones + 0.4) / (zeros + ones + 0.8)
    for k in (1, 2):
        at = slice(int(BASE[k]), int(BASE[k + 1]))
        parent = np.tile(p[:NODES], SLOTS[k] // NODES)
        p[at] = (ones[at] + PRIOR * parent) / (zeros[at] + ones[at] + PRIOR)
    out[:words] = np.log(p / (1 - p))
    return out, seen


def score_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", coded: int = CODED) -> DataFrame:
    """Adds held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte to every row.

    The model learns from the rows whose crc32(doc_id as text) mod 7 isn't 2.
    A token is coded as binary decisions: the steps of a code of the most
    frequent words, then, for other words, the bits of their letters. Predictors
    hashed by context (the node, the last function word, the word before; one
    to three letters before) each give a decision a logit from the counts of
    all training texts. They are added up with weights that the decision's gate
    (place in the tree or in the word) picks and that every text refines block
    by block; score is the log10 probability of the whole text, its end
    included, and bits_per_byte its cost in bits over the text's UTF-8 bytes (over
    1 of an empty one). The first weights are fitted on all decisions of all
    training texts (fit_all), each predicted from contexts that have not met it.

    A null or empty text is just its end; a null doc_id counts as the text '';
    repeated rows are learned and scored each; with no training rows the
    predictors are even; an empty table stays empty; a text is read whole, in
    parts of a batch and stretches of its own; input columns called as an output are replaced.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    df = without(docs, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte").withColumn("held_out", held_out(F.col(f"`{doc_id}`")))
    train = df.where("NOT held_out").select(F.col(f"`{text}`").alias("t"))
    counts = cut(token_counts(train), "lm-tokens")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    code = make_code(counts, n, coded)
    shared = sc.broadcast(code)
    sample = [(Bits(code, [tokens_of(t)], learn=True), copies) for t, copies in fit_sample(train)]
    slots = np.unique(np.concatenate([np.empty(0, np.int64), *[slots_of(b) for b, _ in sample]]))
    blobs = [(r["segment"], bytes(r["blob"])) for r in predictor_counts(train, shared).toLocalIterator()]  # the tables' size is fixed, whatever the corpus
    logit, seen = slot_logits(iter(blobs), slots)
    start = fit_start(sample, slots, seen)
    del sample, slots, seen
    start = fit_all(train, counts, shared, blobs, start)
    del blobs
    model = sc.broadcast((logit, start))
    names = [c for c in df.columns if c != text]
    known = n + v + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, (logit, start) = shared.value, model.value
        row = TaskContext.get().partitionId() << 33
        base = np.append(np.log10((code.counts * (n > 0) + 1) / known), 0.0)  # without training, the end of text was not met either
        for b in batches:
            k = b.num_columns - 1
            sizes = [n or 0 for n in pc.binary_length(b.column(k)).to_pylist()]
            for first, texts in _parts(b.column(k)):
                part = b.slice(first, len(texts))
                said, cost = text_bits(code, logit, start, texts)
                mine: list[Counter] = [Counter() for _ in texts]
                total, known_here, score0 = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts))
                for s in said:
                    doc = np.repeat(np.arange(len(texts)), s.n)
                    rare = np.flatnonzero(s.ids == code.spelled)
                    for i, d in zip(rare.tolist(), doc[rare].tolist(), strict=True):
                        mine[d][s.flat[i]] += 1
                    total += s.n
                    known_here += s.n - np.bincount(doc[rare], minlength=len(texts))
                    score0 += np.bincount(doc, base[s.ids], len(texts))
                other = pa.array([[{"token": w, "k": c} for w, c in m.items()] for m in mine], pa.list_(pa.struct([("token", pa.binary()), ("k", pa.int64())])))
                cols = [part.column(i) for i in range(k)]
                cols += [pa.array(np.arange(row, row + len(texts))), pa.array(total), pa.array(known_here), pa.array(score0), pa.array(-cost * np.log10(2)), pa.array(cost / np.array([max(1, size) for size in sizes[first : first + len(texts)]])), other]
                row += len(texts)
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "_row", "n_tokens", "_coded", "_base", "score", "bits_per_byte", "_other"])

    slim = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("_t"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop(text).schema)
    scored = cut(slim.mapInArrow(run, f"{fields}, _row long, n_tokens long, _coded long, _base double, score double, bits_per_byte double, _other array<struct<token:binary,k:long>>"), "lm-scored")
    rare = scored.select("_row", F.explode("_other").alias("o")).select("_row", "o.token", "o.k").join(counts, "token", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("_row").agg(F.sum(F.col("k") * F.log10((c + 1) / F.lit(float(known)))).alias("_more"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("_seen"))
    out = scored.drop("_other").join(rare, "_row", "left")
    end_seen = n > 0
    seen = F.col("_coded") + F.coalesce("_seen", F.lit(0)) - (0 if end_seen else 1)
    return out.select(*[F.col(f"`{c}`") for c in names], "n_tokens", seen.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("_base") + F.coalesce("_more", F.lit(0.0))).alias("base_score"), "score", "bits_per_byte")


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the mixed model and under the add-one unigram base."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
