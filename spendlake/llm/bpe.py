"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, in order, by *merge gadgets* over an automaton whose arcs are
labelled with tokens and which accepts exactly the token sequences that BPE produces. It
starts with one state per byte and all byte arcs. The gadget of merge ``(u, v) -> w``

* adds a state ``w`` whose outgoing arcs are those of state ``v`` at that moment,
* adds an arc ``w`` to every state that has an arc ``u`` (for ``u == v`` not to ``u``
  itself: the leftmost pair merges first),
* removes the arc ``v`` from state ``u``.

The automaton is deterministic in its labels and every accepted string of labels spells
one byte string, so a word has exactly one path. Written out, a 50k vocabulary has about
2.5e9 arcs; the tables keep for every state where its arcs come from (``right``), for every
label whose arcs it follows (``left``), the gadget that made it (``born``) and the removed
arcs (``cut``), from which any arc is looked up in a few steps.

Empty or null text gives no tokens. A word of any length takes time proportional to its
length. Extra columns are passed on; columns named like an output are replaced.
"""
from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spendlake.llm.common import Step, apply_steps, takes_over, texts_of

#: Fixed value: how byte-level BPE splits a text into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of Latin-1 characters only, spelled out for the faster ``re`` module:
#: letters, numbers and white space of that range.
L1, N1, S1 = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
SPLIT_L1 = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{L1}]+| ?[{N1}]+| ?[^{S1}{L1}{N1}]+|[{S1}]+(?![^{S1}])|[{S1}]+"
#: Words whose ids, and transitions, that a worker remembers.
MEMORY_WORDS, MEMORY_MOVES = 300_000, 300_000


def byte_symbols() -> dict[str, int]:
    """Symbol -> byte of byte-level vocabularies: printable Latin-1 characters stand for
    themselves, the other bytes take the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """Deterministic automaton compiled from a vocabulary and its ordered merges."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        vocab = model["model"]["vocab"]
        sym = byte_symbols()
        size = 1 + max([*vocab.values(), *(t["id"] for t in model["added_tokens"])])
        self.label = [b""] * size
        for token, i in vocab.items():
            self.label[i] = bytes(sym[c] for c in token) if all(c in sym for c in token) else token.encode()
        self.specials = {t["content"]: t["id"] for t in model["added_tokens"]}
        for token, i in self.specials.items():
            self.label[i] = token.encode()
        self.left, self.right, self.born = [-1] * size, [-1] * size, [0] * size
        self.cut: dict[int, int] = {}
        alive = [vocab[c] for c in sym if c in vocab]
        usable = [False] * size
        for i in alive:
            usable[i] = True
        for k, m in enumerate(model["model"]["merges"], 1):
            a, b = m if isinstance(m, list) else m.split(" ")
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if usable[w] or not (usable[u] and usable[v] and self._arc(u, v, k - 1)):
                continue  # the pair never meets, or the label exists already
            self.left[w], self.right[w], self.born[w], usable[w] = u, v, k, True
            self.cut[u << 32 | v] = k
            alive.append(w)
        self._compile_labels(alive)
        self.words: dict[str, bytes] = {}
        parts = "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))
        self.special_re = regex.compile(f"({parts})") if parts else None
        self.split_any = regex.compile(SPLIT).findall
        self.split_l1 = re.compile(SPLIT_L1).findall

    def _arc(self, s: int, t: int, at: int) -> bool:
        """Does the arc ``t`` leave state ``s`` after the gadgets 1..at?"""
        born, left, right, cut = self.born, self.left, self.right, self.cut
        while True:
            if cut.get(s << 32 | t, at + 1) <= at:
                return False
            if born[t] == 0 and born[s] == 0:
                return True
            if born[t] >= born[s]:
                u, v, at = left[t], right[t], born[t] - 1
                if s == t:
                    s, t = v, u
                elif u == v == s:
                    return False
                else:
                    t = u
            else:
                s, at = right[s], born[s] - 1

    def _compile_labels(self, alive: list[int]) -> None:
        """Byte trie of the labels: ``step`` its transitions, ``ends`` the label that ends at
        a node, ``depth`` its length, ``leaf`` whether it goes no further."""
        self.step: dict[int, int] = {}
        self.ends, self.depth, self.leaf = [-1], [0], [True]
        for i in alive:
            node = 0
            for b in self.label[i]:
                nxt = self.step.get(node << 8 | b)
                if nxt is None:
                    nxt = self.step[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.leaf.append(True)
                    self.leaf[node] = False
                node = nxt
            self.ends[node] = i
        self._forget()

    def _forget(self) -> None:
        """Empty byte-driven table; it fills again as words are read."""
        self.arcs: dict[int, bool] = {}
        self.states = [((0, -1),)]
        self.state_of = {self.states[0]: 0}
        self.move: dict[int, tuple[int, int, int]] = {}

    def _advance(self, state: int, byte: int) -> tuple[int, int, int]:
        """One transition of the byte-driven form of the automaton. A state holds, for every
        position that a label under way may have begun at, the trie node reached from there
        and the label that ends there. Of the labels that end at this byte exactly one fits
        its predecessor. Gives the next state, that label and its length."""
        label, size, live = -1, 0, []
        for node, last in self.states[state]:
            node = self.step.get(node << 8 | byte)
            if node is None:
                continue
            t = self.ends[node]
            if t >= 0 and label < 0:
                ok = True
                if last >= 0:
                    ok = self.arcs.get(last << 32 | t)
                    if ok is None:
                        ok = self.arcs[last << 32 | t] = self._arc(last, t, 1 << 40)
                if ok:
                    label, size = t, self.depth[node]
            if not self.leaf[node]:
                live.append((node, last))
        key = (*live, (0, label))
        to = self.state_of.get(key)
        if to is None:
            to = self.state_of[key] = len(self.states)
            self.states.append(key)
        got = self.move[state << 8 | byte] = (to, label, size)
        return got

    def path(self, word: bytes) -> list[int]:
        """Labels of the word's only path: one table transition per byte, then the labels are
        read off backwards from the end."""
        if len(self.move) > MEMORY_MOVES:
            self._forget()
        state, move, seen = 0, self.move, []
        for b in word:
            got = move.get(state << 8 | b) or self._advance(state, b)
            state = got[0]
            seen.append(got)
        out, i = [], len(word)
        while i:
            _, label, size = seen[i - 1]
            out.append(label)
            i -= size
        return out[::-1]

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.split_l1(text)

    def _plain(self, text: str) -> bytes:
        words, known = self.split(text), self.words
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > MEMORY_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = array("I", self.path(w.encode())).tobytes()
            return b"".join(map(known.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; strings of special tokens become
        their own id."""
        if self.special_re is None or not any(s in text for s in self.specials):
            return self._plain(text)
        out = []
        for part in self.special_re.split(text):
            sid = self.specials.get(part)
            out.append(np.array([sid], "<u4").tobytes() if sid is not None else self._plain(part))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.label.__getitem__, ids.tolist())).decode("utf-8", "replace")


_BUILT: dict[str, MergeAutomaton] = {}


def _forget_built() -> None:
    _BUILT.clear()


def automaton(spec: str) -> MergeAutomaton:
    """The worker's automaton for a tokenizer file's text, compiled once per process."""
    takes_over("bpe", _forget_built)
    key = hashlib.sha1(spec.encode()).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = MergeAutomaton(spec)
    return _BUILT[key]


def read_spec(path: str) -> str:
    """Text of a tokenizer JSON file; its size is bounded by the vocabulary, so it travels
    with the plan to the executors."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _list_array(parts: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
    flat = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def list_rows(col: pa.ListArray) -> list[np.ndarray]:
    """Rows of an Arrow list column of ids as numpy views; null as empty."""
    offs, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
    ok = col.is_valid().to_numpy(zero_copy_only=False)
    return [flat[a:b] if v else flat[:0] for a, b, v in zip(offs[:-1], offs[1:], ok)]


def encode_step(path: str, text_col: str = "text", out: str = "ids") -> Step:
    spec = read_spec(path)

    def fn(get):
        m = automaton(spec)
        return [_list_array([m.encode(t) for t in texts_of(get(text_col))])]

    return Step([(out, T.ArrayType(T.IntegerType()))], fn)


def decode_step(path: str, ids_col: str = "ids", out: str = "decoded") -> Step:
    spec = read_spec(path)

    def fn(get):
        m = automaton(spec)
        return [pa.array([m.decode(r) for r in list_rows(get(ids_col))], pa.string())]

    return Step([(out, T.StringType())], fn)


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: the token ids of the text (null: none) under the tokenizer file."""
    return apply_steps(df, [encode_step(path, text_col, out)])


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the text that the ids spell (null ids: empty); invalid UTF-8 becomes U+FFFD."""
    return apply_steps(df, [decode_step(path, ids_col, out)])


def digest_step(ids_col: str = "ids", text_col: str = "decoded") -> Step:
    """Token count and SHA-256 of the ids (little-endian u32) and of the text (UTF-8)."""
    def fn(get):
        rows = [np.ascontiguousarray(r, "<u4") for r in list_rows(get(ids_col))]
        hexa = lambda b: hashlib.sha256(b).hexdigest()
        return [pa.array([len(r) for r in rows], pa.int64()), pa.array([hexa(r.tobytes()) for r in rows], pa.string()),
                pa.array([hexa(t.encode()) for t in texts_of(get(text_col))], pa.string())]

    return Step([("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], fn)


def digests(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass; ids and decoded text stay in the worker."""
    return apply_steps(df, [encode_step(path, text_col), decode_step(path), digest_step()],
                       drop=("ids", "decoded", text_col))
