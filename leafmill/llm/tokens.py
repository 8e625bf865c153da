"""Sub-word ids of whole texts through the tokenizers library, with a bounded memo of its chunks."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: File used where no path is given; looked up on the executor, never copied.
DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: A word of Latin letters and the ASCII marks that follow it: two runs of pre-tokens of their own.
_MARKED = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]+)")
#: Chunks that are one pre-token each, whatever stands around them.
_PLAIN = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-/:-@\[-`{-~]+)")
_SPACE = re.compile(r"(?<=\S)(?= )")
_LETTERS = frozenset(c for c in map(chr, range(256)) if re.fullmatch("[A-Za-zÀ-ÖØ-öø-ÿ0-9]", c))
#: White space other than the space and the line feed.
_OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Symbols by which a byte-level model names bytes.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SYMBOLS = dict(zip(_PRINTED, map(chr, _PRINTED))) | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}
_ENCODERS: dict[str, ChunkEncoder] = {}


def _cut(text: str) -> str:
    """A text without U+0000 with one wherever no pre-token reaches across: before spaces, around line feeds, before a comma or full stop after a letter or digit."""
    if "  " in text or "\n\n" in text or " \n" in text or any(c in text for c in _OTHER_SPACE):
        return "\x00".join(_SPACE.split(text))
    cut = text.replace(" ", "\x00 ")
    if "\n" in text:
        cut = cut.replace("\n", "\x00\n\x00")
    for mark in ",.":
        parts = cut.split(mark + "\x00")
        if len(parts) > 1:
            last = parts.pop()
            cut = "".join([p + ("\x00" + mark + "\x00" if p[-1:] in _LETTERS else mark + "\x00") for p in parts]) + last
    return cut


class ChunkEncoder:
    """Encodes texts to little-endian uint32 ids, equal to Tokenizer.encode(text, add_special_tokens=False).

    A byte-level BPE never merges across its pre-tokens, and a space after a non-space always opens
    a pre-token. A text is therefore cut before such spaces (and at more places, see _cut()); each distinct chunk goes through the
    library once while the memo holds it, words apart from the marks after them. Chunks that are one
    pre-token go to the library's model at once. Others that begin
    with at most one space and end in a non-space are encoded jointly, as one string, and cut apart by
    byte lengths. Texts with a special token's
    string or U+0000 go through the library whole. At max_memo entries the memo becomes the older one, whose chunks
    come back as they are met again, and the one that was older before is dropped.
    """

    def __init__(self, path: str, max_memo: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_ids = max(vocab.values()) + 1
        self.bytes_of = np.zeros(self.n_ids, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)
        kind = json.loads(self.tokenizer.to_str())
        first = kind["pre_tokenizer"] or {}
        byte_level = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True)
        #: The model itself, if nothing but the byte-level split comes before it.
        self.model = self.tokenizer.model if byte_level and not kind["normalizer"] and not kind["post_processor"] else None
        self.four = [i.to_bytes(4, "little") for i in range(self.n_ids)]
        self.memo: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.max_memo = max_memo

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, chunks: list[str]) -> None:
        memo, older = self.memo, self.older
        words, todo, parts = [], set(), {}
        for c in chunks:
            if (raw := older.get(c)) is not None:
                memo[c] = raw
            elif self.model is not None and _PLAIN.fullmatch(c):
                words.append(c)
            elif m := _MARKED.fullmatch(c):
                parts[c] = m.groups()
            else:
                todo.add(c)
        if parts:
            own = set().union(*parts.values()).difference(memo, words)
            if self.model is None:
                todo |= own
            else:
                words += own
        self._learn_words(words)
        spaced, bare, single = [], [], []
        for c in sorted(todo):
            if c[0].isspace() and (c[0] != " " or len(c) == 1 or c[1].isspace()) or c[-1].isspace():
                single.append(c)
            else:
                (spaced if c[0] == " " else bare).append(c)
        for group, between in ((spaced, ""), (bare, "\n")):
            for k in range(0, len(group), 2000):
                single += self._learn_joint(group[k : k + 2000], between)
        if single:
            memo.update(zip(single, self._whole(single)))
        for c, (word, marks) in parts.items():
            memo[c] = memo[word] + memo[marks]

    def _learn_words(self, words: list[str]) -> None:
        """Learn chunks that are one pre-token each from the model, in the symbols it has for their bytes."""
        four, tokenize = self.four, self.model.tokenize
        named = "\n".join(words).encode().decode("latin-1").translate(_SYMBOLS).split(_SYMBOLS[10])
        for c, symbols in zip(words, named):
            self.memo[c] = b"".join([four[t.id] for t in tokenize(symbols)])

    def _learn_joint(self, chunks: list[str], between: str) -> list[str]:
        """Learn chunks from one string; gives them back if its tokens don't end where they do."""
        raw = self._whole([between.join(chunks)])[0]
        reached = np.cumsum(self.bytes_of[np.frombuffer(raw, "<u4")])
        sizes = np.array([len(c.encode("utf-8", "surrogatepass")) for c in chunks])
        ends = np.cumsum(sizes + len(between)) - len(between)
        begins = ends - sizes
        last, first = np.searchsorted(reached, ends), np.searchsorted(reached, begins, side="right")
        if last[-1] >= len(reached) or (reached[last] != ends).any() or (begins[1:] != reached[first[1:] - 1]).any():
            return chunks
        for c, a, b in zip(chunks, (first * 4).tolist(), ((last + 1) * 4).tolist()):
            self.memo[c] = raw[a:b]
        return []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes; each distinct chunk of a call is looked up once."""
        if len(self.memo) > self.max_memo:
            self.older, self.memo = self.memo, {"": b""}
        out: list[bytes] = [b""] * len(texts)
        open_texts: list[int] = []
        for i, text in enumerate(texts):
            if "\x00" in text or any(s in text for s in self.special):
                out[i] = self._whole([text])[0]
            else:
                open_texts.append(i)
        if not open_texts:
            return out
        lists = pc.split_pattern(pa.array([_cut(texts[i]) for i in open_texts], pa.large_string()), "\x00")
        coded = lists.values.dictionary_encode()
        one = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        chunks, at = pc.binary_join(one, pa.scalar("\x00", pa.large_string()))[0].as_py().split("\x00"), coded.indices.to_numpy()
        get = self.memo.get
        ids = list(map(get, chunks))
        if None in ids:
            self._learn([c for c, x in zip(chunks, ids) if x is None])
            ids = list(map(get, chunks))
        # The ids of all chunks one after another, and from there those of each place.
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins, n = np.cumsum(sizes) - sizes, sizes[at]
        ends = np.cumsum(n)
        source = np.repeat(begins[at] - (ends - n), n)
        source += np.arange(len(source))
        raw = np.frombuffer(b"".join(ids), "<u4")[source].tobytes()
        bounds = (np.concatenate([[0], ends])[lists.offsets.to_numpy()] * 4).tolist()
        for i, a, b in zip(open_texts, bounds, bounds[1:]):
            out[i] = raw[a:b]
        return out


def encoder(path: str | None = None) -> ChunkEncoder:
    """This process's encoder of a vocabulary file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(DEFAULT_VOCABULARY)
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def forget_encoders() -> None:
    """Drop this process's encoders, with what they remember."""
    _ENCODERS.clear()


def encode_slices(texts: list[str | None], path: str | None, chars: int = 2_000_000):
    """Yield (index, ids as bytes) for all texts, a bounded number of characters at a time; null counts as empty."""
    enc, begin, size = encoder(path), 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars or i + 1 == len(texts):
            for k, raw in enumerate(enc.encode([t or "" for t in texts[begin : i + 1]]), begin):
                yield k, raw
            begin, size = i + 1, 0
