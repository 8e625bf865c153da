"""Language-model scoring: a causal self-attention model over sub-word ids, trained and run in numpy.

The text is its lower-case words (A-Z), each encoded after one space by a public vocabulary, then an end. The model gives
the next sub-word as P(class | context) P(sub-word | class, group of the sub-word before):

* Counts first, over all training documents, summed in Spark: how often ids stand beside the CONTEXTS commonest ids. k-means
  of what precedes an id gives its class, of what follows it its group. A second pass counts ids by the group before
  them, and classes by the id before them: the second factor, and the start of the first one's direct path.
* P(class | context) is one causal self-attention layer. Queries, keys and values are tables by group, with a learnt bias by
  distance; the direct path is a table by id, plus one by group. Exponentials are linear between powers of two, and
  normalised as any softmax is, so probabilities add up to one.
* It is trained by back-propagation on all windows of every training document, once each. Documents are dealt by hash to
  shards of about SHARD_IDS ids; a shard is trained through in a set order. Round by round GROWTH times as many shards
  go on from the average of the round before, so the result doesn't depend on how the table is partitioned.

Scoring cuts a document into overlapping windows of WINDOW tokens; each scores its last STEP, so that every token
is scored once, with at least WINDOW - STEP tokens before it. Batches of windows share masked matrix products.
"""

from __future__ import annotations

import base64
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import require, staged

WINDOW, STEP = 32, 24
#: Windows of training follow each other without overlap: every token is a target once.
TRAIN_WINDOW = 24
WIDTH, CLASSES, GROUPS = 16, 32, 256
CONTEXTS = 256
#: Ids of a shard, and shards at most (then they are larger); shards of a round for each of the one before.
SHARD_IDS = 4_000_000
MAX_SHARDS = 4096
GROWTH = 8
#: Words whose counts are broadcast, and whose ids workers remember; the others' counts meet their documents in a shuffled join.
HEAD_WORDS = 300_000
#: Bytes of texts whose words are held at once.
SLICE_BYTES = 8 << 20
BATCH_WINDOWS = 96
TRAIN_BATCH = 512
#: Windows of a training batch that are worked on at once.
GRADIENT_WINDOWS = 64
#: Ids of texts held at once while counting and scoring.
SEQUENCE_IDS = 400_000
#: Ids that a shard holds before it trains on them.
TRAIN_IDS = 100_000
#: Ids that one task counts neighbours of, at least (in MAX_SHARDS tasks at most): a task passes on as many cells for few ids as for many.
COUNT_IDS = 40_000_000
#: Counts sent to the driver at once.
CELLS_AT_ONCE = 4_000_000
#: Weight of the prior in a class by the id before, and in a sub-word by the group before.
PRIOR_CLASS, PRIOR_WITHIN = 5.0, 2.0
#: Greatest norms of rows: queries, keys; values, group's direct path; id's direct path; columns of the output. They keep logits within 85.
MOST_QK, MOST_V, MOST_R, MOST_OUT, MOST_BIAS = 6.0, 6.0, 24.0, 1.7, 20.0
#: exp(x) is about the float whose bits are the integer SCALE x + SHIFT.
SCALE, SHIFT = np.float32(2**23 / np.log(2)), np.float32(127 * 2**23 - 366_393)
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_ENCODINGS: dict = {}
_HEADS: dict = {}
_OTHER_SPACE = re.compile(r"[^\S ]")


def encoding(path: str | None = None):
    """This process's sub-word encoding of a ranks file; returns (encoding, id of the end, which ids begin with a space)."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        begins = np.zeros(len(ranks) + 1, bool)
        begins[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        _ENCODINGS[path] = (tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks), begins)
    return _ENCODINGS[path]


def words_of(text: bytes) -> list[bytes]:
    """Lower-case (A-Z) words of a text in UTF-8."""
    return text.translate(_LOWER).split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """words_of all texts, one after the other, and how many each has; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, n = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    held = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty word
    if not held.all():
        flat, n = flat.filter(pa.array(held)), np.bincount(np.repeat(np.arange(len(n)), n)[held], minlength=len(n))
    return flat, n.astype(np.int64)


def _slices(batch: pa.RecordBatch, column: int):
    """Parts of a batch of rows with about SLICE_BYTES of texts each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_BYTES, "right")))
        yield batch.slice(a, b - a)
        a = b


def id_type(end: int) -> str:
    """How ids are stored: two bytes each where they fit."""
    return "<u2" if end < 1 << 16 else "<u4"


def encoded_words(words: list[bytes], vocabulary: str | None = None) -> list[bytes]:
    """Ids of each word after a space, as bytes of id_type.

    Words are encoded together, and cut apart where an id begins with a space; those with white space of their own, one by one.
    """
    enc, end, begins = encoding(vocabulary)
    kind = id_type(end)
    if not words:
        return []
    texts = b"\x20".join(words).decode("utf-8", "replace")
    if not _OTHER_SPACE.search(texts):
        ids = np.array(enc.encode_ordinary(" " + texts), kind)
        first = np.flatnonzero(begins[ids])
        if len(first) == len(words):
            raw, at = ids.tobytes(), [*(first * ids.itemsize).tolist(), ids.nbytes]
            return [raw[a:b] for a, b in zip(at, at[1:])]
    return [np.array(enc.encode_ordinary(" " + w.decode("utf-8", "replace")), kind).tobytes() for w in words]


def subwords(words: list[bytes], vocabulary: str | None = None) -> np.ndarray:
    """Ids of the words, each after a space, and the end."""
    _, end, _ = encoding(vocabulary)
    return np.array([*np.frombuffer(b"".join(encoded_words(words, vocabulary)), id_type(end)), end], np.int32)


def exponential(bits: np.ndarray) -> np.ndarray:
    """exp(x) for bits = SCALE x + SHIFT, off by 6 per cent at most; |x| is below 87."""
    return bits.astype(np.int32).view(np.float32)


@dataclass
class Model:
    """class and group of each id, log P(id | class, group before), the ids' direct path (its last component is zero), and the trained weights."""

    classes: np.ndarray
    groups: np.ndarray
    log_within: np.ndarray
    direct: np.ndarray
    weights: dict[str, np.ndarray]
    end: int

    def tables(self) -> None:
        """What scoring looks up."""
        w = self.weights
        self.kv, self.q = key_values(w), w["q"] * SCALE
        self.bias, self.mask = distance_bits(w["distance"], WINDOW, STEP)
        self.r = self.direct + np.pad(w["r"], ((0, 0), (0, 1)))[self.groups]
        self.out = output_bits(w)

    def log_probabilities(self, windows: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log P of targets (n, STEP), given windows (n, WINDOW) whose last STEP tokens precede them."""
        out = np.empty(targets.shape, np.float64)
        ones = np.ones(CLASSES, np.float32)
        for a in range(0, len(windows), BATCH_WINDOWS):
            ids, goal = windows[a : a + BATCH_WINDOWS], targets[a : a + BATCH_WINDOWS].ravel()
            groups, last = self.groups.take(ids), ids[:, WINDOW - STEP :]
            kv, q = self.kv.take(groups, axis=0), self.q.take(groups[:, WINDOW - STEP :], axis=0)
            s = np.matmul(q, kv[:, :, :WIDTH].transpose(0, 2, 1))
            s += self.bias
            s = exponential(s)
            s *= self.mask
            h = np.matmul(s, kv[:, :, WIDTH:])
            h *= 1 / h[:, :, WIDTH - 1 :]
            h += self.r.take(last, axis=0)
            p = exponential(h.reshape(-1, WIDTH) @ self.out)
            own = p.take(np.arange(0, p.size, CLASSES) + self.classes.take(goal))
            own /= p @ ones
            within = self.log_within.take(goal * np.int64(GROUPS) + groups[:, WINDOW - STEP :].ravel())
            out[a : a + BATCH_WINDOWS] = (np.log(own) + within).reshape(-1, STEP)
        return out


def key_values(w: dict[str, np.ndarray]) -> np.ndarray:
    """(GROUPS, 2 WIDTH): keys, values, and a one that sums what values are weighed by."""
    return np.concatenate([w["k"], w["v"], np.ones((GROUPS, 1), np.float32)], 1)


def output_bits(w: dict[str, np.ndarray]) -> np.ndarray:
    """(WIDTH, CLASSES) from a state whose last component is one, to the bits of exponentials."""
    return np.concatenate([w["out"] * SCALE, (w["class"] * SCALE + SHIFT)[None]]).astype(np.float32)


def distance_bits(distance: np.ndarray, window: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(step, window) bias by how far a key is before its query, as bits, and the mask of later keys."""
    d = (np.arange(step)[:, None] + window - step) - np.arange(window)[None]
    return (distance[np.clip(d, 0, len(distance) - 1)] * SCALE + SHIFT).astype(np.float32), (d >= 0).astype(np.float32)


def cut_windows(sequences: list[np.ndarray], end: int, window: int = WINDOW, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(windows, targets, which targets count, first window of each sequence); an end precedes each sequence. Neighbouring windows share a step at most."""
    size = np.array([len(ids) for ids in sequences])
    blocks = -(-size // step)
    first, n = np.cumsum(blocks) - blocks, int(blocks.sum())
    at = np.repeat(first * step - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    goals, real = np.full(n * step, end, np.int32), np.zeros(n * step, bool)
    goals[at] = np.concatenate(sequences)
    real[at] = True
    before = np.empty(n * step, np.int32)
    before[1:] = goals[:-1]
    before[first * step] = end
    before = before.reshape(n, step)
    if (more := window - step) > 0:
        lead = np.empty((n, more), np.int32)
        lead[1:] = before[:-1, step - more :]
        lead[first] = end
        before = np.concatenate([lead, before], 1)
    return before, goals.reshape(n, step), real.reshape(n, step), first


def score_sequences(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence of ids (the end included)."""
    windows, targets, real, first = cut_windows(sequences, model.end)
    p = model.log_probabilities(windows, targets)
    p[~real] = 0
    return np.add.reduceat(p.sum(1), first) / np.log(10)


def context_columns(frequency: np.ndarray) -> np.ndarray:
    """The column of each id as a context, the commonest first; -1 if it is none."""
    column = np.full(len(frequency), -1)
    top = np.argsort(-frequency, kind="stable")[: min(CONTEXTS, np.count_nonzero(frequency))]
    column[top] = np.arange(len(top))
    return column


def neighbour_cells(before: np.ndarray, after: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Cells (id times 2 CONTEXTS, plus column) of ids that follow, and precede, an id with a column."""
    left, right = column[before], column[after]
    return np.concatenate([(after * (2 * CONTEXTS) + left)[left >= 0], (before * (2 * CONTEXTS) + CONTEXTS + right)[right >= 0]])


def joint_cells(before: np.ndarray, after: np.ndarray, classes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Cells (id times (GROUPS + CLASSES), plus column) of ids by the group before them, and of ids by the class after them."""
    wide = GROUPS + CLASSES
    return np.concatenate([after * wide + groups[before], before * wide + GROUPS + classes[after]])


def clusters(counts: np.ndarray, n: int, frequency: np.ndarray, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means by cosine of log counts, rows weighed by the root of their frequency."""
    x = np.log1p(counts)
    x /= np.linalg.norm(x, axis=1, keepdims=True).clip(1e-6)
    rng, weight = np.random.default_rng(seed), frequency.astype(np.float64) ** 0.5
    centres = x[rng.choice(len(x), min(n, len(x)), replace=False, p=weight / weight.sum())]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(1)
        order = np.argsort(nearest, kind="stable")
        first = np.searchsorted(nearest[order], np.arange(len(centres) + 1))
        for c in np.flatnonzero(np.diff(first)):
            rows = order[first[c] : first[c + 1]]
            centre = weight[rows] @ x[rows]
            centres[c] = centre / max(1e-6, np.linalg.norm(centre))
    return nearest


def cluster_ids(seen: np.ndarray, frequency: np.ndarray, counts: np.ndarray, size: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(class, group) of all ids from seen ids' frequencies and neighbour counts; those of others are by number."""
    classes, groups = np.arange(size) % CLASSES, (np.arange(size) % GROUPS).astype(np.uint8)
    if len(seen):
        classes[seen] = clusters(counts[:, :CONTEXTS], CLASSES, frequency, seed)
        groups[seen] = clusters(counts[:, CONTEXTS:], GROUPS, frequency, seed + 1)
    return classes, groups


def assemble(total: np.ndarray, classes: np.ndarray, groups: np.ndarray, by_group: np.ndarray, by_class: np.ndarray, seed: int = 4) -> Model:
    """The untrained model from counts of ids, of ids by the group before (size, GROUPS), and of classes by the id before (size, CLASSES)."""
    own = total + 0.1
    of_class = np.bincount(classes, own, CLASSES)
    share = (own / of_class[classes]).astype(np.float32)
    of_both = np.zeros((CLASSES, GROUPS), np.float32)
    np.add.at(of_both, classes, by_group)
    within = by_group.astype(np.float32)
    within += PRIOR_WITHIN * share[:, None]
    within /= (of_both + PRIOR_WITHIN)[classes]
    np.log(within, out=within)
    common = (of_class / of_class.sum()).clip(1e-8)
    n = by_class.sum(1, keepdims=True)
    lift = np.log((by_class + PRIOR_CLASS * common) / (n + PRIOR_CLASS)) - np.log(common)
    _, vectors = np.linalg.eigh((lift * n).T @ lift)
    out = vectors[:, -(WIDTH - 1) :]
    rng = np.random.default_rng(seed)
    draw = lambda wide, scale: (rng.normal(size=(GROUPS, wide)) * scale).astype(np.float32)
    weights = {
        "q": draw(WIDTH, 0.3), "k": draw(WIDTH, 0.3), "v": draw(WIDTH - 1, 0.1), "r": np.zeros((GROUPS, WIDTH - 1), np.float32),
        "out": np.ascontiguousarray(out.T, np.float32), "class": np.log(common).astype(np.float32), "distance": np.linspace(1, 0, WINDOW, dtype=np.float32),
    }
    direct = np.pad(_shorter((lift @ out).astype(np.float32), MOST_R), ((0, 0), (0, 1)))
    return Model(classes, groups, within, direct, _held(weights), len(total) - 1)


def _shorter(x: np.ndarray, most: float, axis: int = 1) -> np.ndarray:
    """x with rows (or columns, along axis 0) of a norm above most cut to it."""
    return x * np.minimum(1, most / np.sqrt((x * x).sum(axis, keepdims=True)).clip(1e-9)).astype(np.float32)


def _held(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Weights within the bounds that keep every logit in the range of exponential()."""
    return {
        "q": _shorter(w["q"], MOST_QK), "k": _shorter(w["k"], MOST_QK), "v": _shorter(w["v"], MOST_V), "r": _shorter(w["r"], MOST_V), "out": _shorter(w["out"], MOST_OUT, 0),
        "class": w["class"].clip(-MOST_BIAS, MOST_BIAS), "distance": w["distance"].clip(-MOST_BIAS, MOST_BIAS),
    }


def _by_group(rows: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """(GROUPS, width) sums of rows (n, width) by group (n)."""
    ends = np.cumsum(np.bincount(groups, minlength=GROUPS)).tolist()
    rows, one = rows.take(np.argsort(groups, kind="stable"), axis=0), np.ones(len(groups), np.float32)
    out = np.zeros((GROUPS, rows.shape[1]), np.float32)
    for own, a, b in zip(out, [0, *ends], ends):
        if a < b:
            np.dot(one[a:b], rows[a:b], out=own)
    return out


def gradients(w: dict[str, np.ndarray], direct: np.ndarray, groups: np.ndarray, goals: np.ndarray, room: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of the class predictions and its gradients.

    direct: (n, window, WIDTH) and groups: (n, window) of the tokens, goals: the next ones' classes, -1 where none counts.
    GRADIENT_WINDOWS at a time go through all steps, which a core's cache holds; room is (n, window, 2 WIDTH) to work in.
    Queries meet keys in a table by both groups, which also sums what they pass back.
    """
    n, window = groups.shape
    meet, values, r, out = (w["q"] * SCALE) @ w["k"].T, key_values(w)[:, WIDTH:], np.zeros((GROUPS, WIDTH), np.float32), output_bits(w)
    r[:, : WIDTH - 1] = w["r"]
    out_back, ones = np.concatenate([w["out"].T, np.zeros((CLASSES, 1), np.float32)], 1), np.ones(CLASSES, np.float32)
    bias, mask = distance_bits(w["distance"], window, window)
    by_token = np.empty((n, window, 2 * WIDTH), np.float32) if room is None else room[:n]  # values, direct path
    by_groups, by_place = np.zeros(GROUPS * GROUPS, np.float32), np.zeros((window, window), np.float32)
    d_out, loss, total = np.zeros((WIDTH, CLASSES), np.float32), 0.0, 0
    for a in range(0, n, GRADIENT_WINDOWS):
        own, sums, goal = groups[a : a + GRADIENT_WINDOWS], by_token[a : a + GRADIENT_WINDOWS], goals[a : a + GRADIENT_WINDOWS].ravel()
        pair = (own.astype(np.uint16)[:, :, None] * np.uint16(GROUPS) + own[:, None, :]).astype(np.intp)
        e = meet.take(pair)
        e += bias
        e = exponential(e)
        e *= mask
        v = values.take(own, axis=0)
        h = np.matmul(e, v)
        scale = 1 / h[:, :, WIDTH - 1 :]
        h *= scale
        attended = h.copy()
        h += direct[a : a + GRADIENT_WINDOWS]
        h += r.take(own, axis=0)
        flat = h.reshape(-1, WIDTH)
        p = exponential(flat @ out)
        real = goal >= 0
        p *= (real.astype(np.float32) / (p @ ones))[:, None]
        at = np.arange(0, p.size, CLASSES) + np.maximum(goal, 0)
        met = p.take(at)
        p.reshape(-1)[at] = met - real
        total += np.count_nonzero(real)
        loss -= float(np.log(met[real]).sum())
        d_out += flat.T @ p
        back = (p @ out_back).reshape(h.shape)
        sums[:, :, WIDTH:] = back
        attended *= back
        back[:, :, WIDTH - 1] = attended @ -ones[:WIDTH]
        back *= scale
        ds = np.matmul(back, v.transpose(0, 2, 1))
        ds *= e
        by_place += ds.sum(0)
        np.add.at(by_groups, pair.ravel(), ds.ravel())
        np.matmul(e.transpose(0, 2, 1), back, out=sums[:, :, :WIDTH])
    sums, by_groups = _by_group(by_token.reshape(-1, 2 * WIDTH), groups.ravel()), by_groups.reshape(GROUPS, GROUPS)
    d = np.arange(window)[:, None] - np.arange(window)[None]
    found = {
        "k": by_groups.T @ w["q"], "v": sums[:, : WIDTH - 1], "q": by_groups @ w["k"], "r": sums[:, WIDTH : 2 * WIDTH - 1], "out": d_out[: WIDTH - 1], "class": d_out[WIDTH - 1],
        "distance": np.bincount(d[d >= 0], by_place[d >= 0], len(w["distance"])).astype(np.float32),
    }
    total = np.float32(max(1, total))
    return loss / float(total), {name: g / total for name, g in found.items()}


class Trainer:
    """Adam over batches of windows in the order in which sequences come; the rate falls with the steps taken."""

    def __init__(self, model: Model, rate: float, warm: int):
        self.model, self.rate, self.warm, self.steps, self.windows = model, rate, warm, 0, 0
        self.w = {k: x.copy() for k, x in model.weights.items()}
        self.m, self.s = {k: np.zeros_like(x) for k, x in self.w.items()}, {k: np.zeros_like(x) for k, x in self.w.items()}
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.room = 0
        self.space = np.empty((TRAIN_BATCH, TRAIN_WINDOW, 2 * WIDTH), np.float32)

    def add(self, sequences: list[np.ndarray]) -> None:
        windows, targets, real, _ = cut_windows(sequences, self.model.end, TRAIN_WINDOW, TRAIN_WINDOW)
        self.held.append((windows, np.where(real, self.model.classes[targets], -1)))
        self.room += len(windows)
        if self.room >= TRAIN_BATCH:
            windows, goals = (np.concatenate(x) for x in zip(*self.held))
            whole = len(windows) // TRAIN_BATCH * TRAIN_BATCH
            for a in range(0, whole, TRAIN_BATCH):
                self._step(windows[a : a + TRAIN_BATCH], goals[a : a + TRAIN_BATCH])
            self.held, self.room = [(windows[whole:], goals[whole:])], len(windows) - whole

    def done(self) -> dict[str, np.ndarray]:
        if self.room:
            self._step(*(np.concatenate(x) for x in zip(*self.held)))
            self.held, self.room = [], 0
        return self.w

    def _step(self, windows: np.ndarray, goals: np.ndarray) -> None:
        _, g = gradients(self.w, self.model.direct.take(windows, axis=0), self.model.groups.take(windows), goals, self.space)
        self.steps += 1
        self.windows += len(windows)
        rate = self.rate * min(1.0, self.steps / self.warm) / np.sqrt(1 + self.steps / 400)
        for name, x in g.items():
            self.m[name] += 0.1 * (x - self.m[name])
            self.s[name] += 0.01 * (x * x - self.s[name])
            self.w[name] = self.w[name] - np.float32(rate / (1 - 0.9**self.steps)) * self.m[name] / (np.sqrt(self.s[name] / (1 - 0.99**self.steps)) + 1e-8).astype(np.float32)
        self.w = _held(self.w)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the training rows of texts, staged; the word '' stands for the end."""

    def count(batches):
        for batch in batches:
            for part in _slices(batch, 0):
                found = pc.value_counts(split_words(part.column(0))[0])
                words, n = found.field("values").cast(pa.binary()), found.field("counts")
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([b""])]), pa.concat_arrays([n, pa.array([part.num_rows], pa.int64())])], names=["word", "n"])

    partial = texts.where("not held_out").select("text").mapInArrow(count, "word binary, n long")
    return staged(partial.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


ENCODED = T.StructType([
    T.StructField("uid", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("tail", T.ArrayType(T.BinaryType())), T.StructField("ids", T.BinaryType()),
])


@dataclass
class Head:
    """What base scores need on every worker: the commonest words, their logs, and the end's log and whether training texts hold it."""

    words: pa.Array
    logs: np.ndarray
    end_log: float
    end_known: bool
    key: str  # workers keep the ids of the words under it


def encoded(texts: DataFrame, head: Head, vocabulary: str | None) -> DataFrame:
    """Each row of texts with its ids, and its base score as far as head knows its words (the others: tail), staged."""
    shared = texts.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in _slices(batch, 2):
                out = encode_texts(rows.column(2), shared.value, vocabulary)
                uid = pa.array([f"{part}-{row + i}" for i in range(rows.num_rows)], pa.string())
                row += rows.num_rows
                yield pa.RecordBatch.from_arrays([uid, rows.column(0), rows.column(1), *out], names=ENCODED.names)

    return staged(texts.mapInArrow(run, ENCODED), "encoded")


def encode_texts(texts: pa.Array, head: Head, vocabulary: str | None = None) -> list[pa.Array]:
    """n_tokens, known, base, tail and ids of each text: ENCODED's columns from the fourth on."""
    _, end, _ = encoding(vocabulary)
    if head.key not in _HEADS:
        _HEADS.clear()
        _HEADS[head.key] = pa.array(encoded_words(head.words.to_pylist(), vocabulary), pa.binary())
    flat, n = split_words(texts)
    flat, owner = flat.cast(pa.binary()), np.repeat(np.arange(len(n)), n)
    index = pc.index_in(flat, value_set=head.words)
    rare = pc.is_null(index).to_numpy(zero_copy_only=False)
    missing = flat.filter(pa.array(rare))
    fresh = pc.unique(missing)
    at = pc.fill_null(index, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at[rare] = len(head.words) + pc.index_in(missing, value_set=fresh).to_numpy(zero_copy_only=False)
    last = end.to_bytes(np.dtype(id_type(end)).itemsize, "little")
    every = pa.concat_arrays([_HEADS[head.key], pa.array([*encoded_words(fresh.to_pylist(), vocabulary), last], pa.binary())])
    ends = np.cumsum(n)
    taken = every.take(pa.array(np.insert(at, ends, len(every) - 1)))
    starts = np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1][np.concatenate([[0], ends + np.arange(1, len(n) + 1)])]
    ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(starts.astype(np.int32).tobytes()), taken.buffers()[2]])
    base = np.bincount(owner[~rare], head.logs[at[~rare]], len(n)) + head.end_log
    n_rare = np.bincount(owner[rare], minlength=len(n))
    tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_rare)]), pa.int32()), missing)
    return [pa.array(n + 1, pa.int64()), pa.array(n - n_rare + head.end_known, pa.int64()), pa.array(base, pa.float64()), tail, ids]


def _sequences(column, kind: str):
    """Lists of the ids of texts, whole, of about SEQUENCE_IDS ids."""
    held, room = [], 0
    for raw in column.to_pylist():
        held.append(np.frombuffer(raw, kind).astype(np.int32))
        room += len(held[-1])
        if room > SEQUENCE_IDS:
            yield held
            held, room = [], 0
    if held:
        yield held


def id_counts(counts: DataFrame, vocabulary: str | None = None) -> np.ndarray:
    """Counts of all ids over the training words, and of the end, from word counts."""

    def count(batches):
        _, end, _ = encoding(vocabulary)
        kind, held = id_type(end), np.zeros(end + 1, np.int64)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ids = [x if w else end.to_bytes(np.dtype(kind).itemsize, "little") for w, x in zip(words, _each(words, vocabulary))]
            flat = np.frombuffer(b"".join(ids), kind)
            held += np.bincount(flat, np.repeat(n, [len(x) // flat.itemsize for x in ids]), end + 1).astype(np.int64)
        ids = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held[ids], pa.int64())], names=["id", "n"])

    total = np.zeros(encoding(vocabulary)[1] + 1, np.int64)
    for r in counts.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row per id at most
        total[r["id"]] = r["n"]
    return total


def _each(words: list[bytes], vocabulary: str | None) -> list[bytes]:
    """encoded_words, where a word may be empty: it has no ids."""
    ids = iter(encoded_words([w for w in words if w], vocabulary))
    return [next(ids) if w else b"" for w in words]


def pair_counts(learning: DataFrame, n_ids: int, order: np.ndarray, wide: int, cells, end: int, name: str) -> np.ndarray:
    """(len(order), wide) counts of the cells that cells(before, after) finds, over all neighbouring ids of learning (ids), n_ids in all.

    order: the ids that occur, the commonest first; cells get places in it, so that what is counted most lies together. An end
    precedes each text.
    """
    kind, rank = id_type(end), np.zeros(end + 1, np.int64)
    rank[order] = np.arange(len(order))
    shared = learning.sparkSession.sparkContext.broadcast(rank)
    n_cells = len(order) * wide

    def count(batches):
        rank, held = shared.value, np.zeros(n_cells, np.int32)
        for batch in batches:
            for sequences in _sequences(batch.column(0), kind):
                after = rank.take(np.concatenate(sequences))
                before = np.concatenate([rank[end : end + 1], after[:-1]])  # each text ends with an end
                np.add.at(held, cells(before, after), np.int32(1))  # of held's own type: a cast would take twenty times as long
        found = np.flatnonzero(held)
        for a in range(0, len(found), 1_000_000):
            part = found[a : a + 1_000_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(held[part], pa.int64())], names=["cell", "n"])

    few = learning.coalesce(min(MAX_SHARDS, max(8, n_ids // COUNT_IDS)))
    found = staged(few.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), name)
    counts = np.zeros(n_cells, np.float32)
    parts = 1 + found.count() // CELLS_AT_ONCE
    for k in range(parts):  # CELLS_AT_ONCE rows or so
        some = found.where(F.pmod("cell", F.lit(parts)) == k).toArrow()
        counts[some.column("cell").to_numpy()] = some.column("n").to_numpy()
    return counts.reshape(len(order), wide)


def fit(documents: DataFrame, word_totals: DataFrame, vocabulary: str | None = None) -> Model:
    """The model from the training rows of documents (doc_id, held_out, ids), staged, and their word counts."""
    spark = documents.sparkSession
    _, end, _ = encoding(vocabulary)
    learning = documents.where("not held_out")
    total = id_counts(word_totals, vocabulary)
    order = np.argsort(-total, kind="stable")[: np.count_nonzero(total)]
    columns = spark.sparkContext.broadcast(context_columns(total)[order])
    n_ids = int(total.sum())
    counts = pair_counts(learning.select("ids"), n_ids, order, 2 * CONTEXTS, lambda b, a: neighbour_cells(b, a, columns.value), end, "neighbours")
    classes, groups = cluster_ids(order, total[order], counts, end + 1)
    del counts
    shared = spark.sparkContext.broadcast((classes[order], groups[order]))
    joint = np.zeros((end + 1, GROUPS + CLASSES), np.float32)
    joint[order] = pair_counts(learning.select("ids"), n_ids, order, GROUPS + CLASSES, lambda b, a: joint_cells(b, a, *shared.value), end, "joint-counts")
    model = assemble(total, classes, groups, joint[:, :GROUPS], joint[:, GROUPS:])
    del joint
    model.weights = train(learning, n_ids, model, vocabulary)
    return model


def train(learning: DataFrame, n_ids: int, model: Model, vocabulary: str | None = None) -> dict[str, np.ndarray]:
    """The weights after all rounds over the rows of learning (doc_id, ids), which hold n_ids ids.

    A row's shard, and its place in it, are hashes of doc_id and ids; equal rows come one after the other.
    """
    spark, kind = learning.sparkSession, id_type(model.end)
    shards = min(MAX_SHARDS, -(-n_ids // SHARD_IDS))
    dealt = learning.select("ids", F.xxhash64("doc_id", "ids").alias("place")).withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)) if shards else F.lit(0).cast("long"))
    names, weights, low = sorted(model.weights), dict(model.weights), 0
    while low < shards:
        high = min(shards, max(1, low * GROWTH))
        start = spark.sparkContext.broadcast(Model(model.classes, model.groups, None, model.direct, weights, model.end))
        rate, warm = (0.016, 50) if low == 0 else (0.005, 20)

        def local(batches, start=start, rate=rate, warm=warm):
            shard, trainer, held, room = None, None, [], 0

            def result():
                trainer.add(held) if held else None
                w = trainer.done()
                flat = np.concatenate([w[k].ravel() for k in names]).astype("<f4")
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([trainer.windows], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["shard", "n", "w"])

            for batch in batches:
                for own, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if own != shard:
                        if shard is not None:
                            yield result()
                        shard, trainer, held, room = own, Trainer(start.value, rate, warm), [], 0
                    held.append(np.frombuffer(raw, kind).astype(np.int32))
                    room += len(held[-1])
                    if room > TRAIN_IDS:
                        trainer.add(held)
                        held, room = [], 0
            if shard is not None:
                yield result()

        rows = dealt.where(F.col("shard").between(low, high - 1)).select("shard", "ids", "place")
        rows = rows.repartition(high - low, "shard").sortWithinPartitions("shard", "place", "ids").select("shard", "ids")
        trained = staged(rows.mapInArrow(local, "shard long, n long, w binary"), "shard-weights")
        weights = _averaged(trained, model.weights, names) or weights
        low = high
    return weights


def _averaged(trained: DataFrame, like: dict[str, np.ndarray], names: list[str]) -> dict[str, np.ndarray] | None:
    """Mean of the shards' weights by their windows; MAX_SHARDS rows at most, added up in the order of shards."""

    def add(batches):
        total, n = None, 0
        for batch in batches:
            for own, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = np.frombuffer(raw, "<f4").astype(np.float64) * own
                total, n = x if total is None else total + x, n + own
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype("<f4").tobytes()], pa.binary())], names=["w"])

    rows = trained.repartition(1).sortWithinPartitions("shard").mapInArrow(add, "w binary").collect()  # one row
    if not rows:
        return None
    flat, out, at = np.frombuffer(rows[0]["w"], "<f4"), {}, 0
    for k in names:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def score(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of documents.

    Null texts are empty: the end alone. A null doc_id counts as the text '' for the hold-out. Rows that share a
    doc_id are scored each. Without training rows all counts are 0, and the model is near even. An empty table gives no rows.
    All training rows are counted and trained on, whole; how the table is partitioned changes no score beyond rounding.
    """
    require(documents, "doc_id", "text")
    spark = documents.sparkSession
    held = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = word_counts(texts)
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, floor = totals["n"], 0.1
    size = tokens + 0.1 * (totals["v"] + 1)
    levels = {r["level"]: r["words"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count("*").alias("words")).collect()}
    least, words = max(levels, default=0) + 1, 0
    while least > 0 and words + levels.get(least - 1, 0) <= HEAD_WORDS:
        least -= 1
        words += levels.get(least, 0)
    frequent = F.floor(F.log2("n")).cast("int") >= least
    rows = encoded(texts, _head(counts, frequent, size), vocabulary)
    model = spark.sparkContext.broadcast(fit(rows.select("doc_id", "held_out", "ids"), counts, vocabulary))
    kind = id_type(encoding(vocabulary)[1])

    def run(batches):
        own = model.value
        own.tables()
        for batch in batches:
            scores = [x for sequences in _sequences(batch.column(6), kind) for x in score_sequences(own, sequences).tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(scores, pa.float64())], names=SCORED.names)

    rare = rows.select("uid", F.explode("tail").alias("word")).join(counts.where(~frequent), "word", "left")
    logs = F.log10((F.coalesce("n", F.lit(0)) + floor) / F.lit(float(size)))
    more = staged(rare.groupBy("uid").agg(F.sum(logs).alias("more"), F.count("n").alias("more_known")), "rare-words")
    scored = rows.select("uid", "doc_id", "held_out", "n_tokens", "known", "base", "ids").mapInArrow(run, SCORED)
    return scored.join(more, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


SCORED = T.StructType([*(f for f in ENCODED if f.name not in ("tail", "ids")), T.StructField("score", T.DoubleType())])


def _head(counts: DataFrame, frequent, size: float) -> Head:
    """Head of the frequent words, HEAD_WORDS at most."""
    held = counts.where(frequent & (F.octet_length("word") > 0)).toArrow().combine_chunks()
    n, ends = held.column("n").to_numpy(), counts.where(F.octet_length("word") == 0).select("n").collect()  # one row
    end_n = ends[0]["n"] if ends else 0
    words = held.column("word")
    words = words.chunk(0) if words.num_chunks else pa.array([], pa.binary())
    return Head(words.cast(pa.binary()), np.log10((n + 0.1) / size), float(np.log10((end_n + 0.1) / size)), end_n > 0, uuid.uuid4().hex)


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    """Contract query: base and model scores of every document."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
