"""BPE encoding and decoding with a tokenization automaton.

The merge list is compiled into a deterministic automaton over tokens by adding one gadget per
merge, in merge order. The gadget of ``u + v`` copies the state behind ``u``, takes ``v`` off the
copy, and lets every state that accepts ``u`` accept ``uv`` too, which leads where ``v`` led.
All arcs of one token end in one state, so a state is a token together with the gadgets that hit
it. States are kept as chains: ``gates[u, v]`` is the step at which the chain of ``u`` lost ``v``,
and ``uv`` shares the chain of ``v`` as it was when ``uv`` was born. Transitions are read from
these tables and kept once computed.

A path of the automaton spells exactly one token sequence per string, the one that merging in
order gives. Encoding walks a pre-split word along the longest arcs first; a prefix from which no
arc leads on is marked dead and the walk goes back one arc. Decoding emits the arcs' byte labels.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracelake.llm.common import worker_table

# A worker keeps at most so many words and transitions. Words go by halves: those of the older half that
# are met again move to the newer one. Transitions start afresh.
WORDS_KEPT = 400_000
STEPS_KEPT = 600_000
NEVER = 1 << 60
LITTLE = sys.byteorder == "little"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=1)
def categories() -> dict[str, list[tuple[int, int]]]:
    """Code-point ranges of letters and numbers, as the tokenizers library's Unicode tables have them."""
    from tokenizers import Regex, pre_tokenizers
    out: dict[str, list[tuple[int, int]]] = {"L": [], "N": []}
    for kind, ranges in out.items():
        split = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True)
        # Block by block, which keeps the driver's memory small; ranges that meet at an edge are joined.
        for low in [*range(0, 0xD800, 2048), *range(0xE000, 0x110000, 2048)]:
            for _, (a, b) in split.pre_tokenize_str("".join(map(chr, range(low, low + 2048)))):
                if ranges and ranges[-1][1] == low + a - 1:
                    a = ranges.pop()[0] - low
                ranges.append((low + a, low + b - 1))
    return out


def _class(ranges: list[tuple[int, int]], top: int) -> str:
    """The ranges up to ``top``, for a character class."""
    return "".join(f"\\U{a:08x}-\\U{min(b, top):08x}" for a, b in ranges if a <= top)


#: Fixed value: the white space of the vocabulary's splitting rule.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def splitter(ranges: dict[str, list[tuple[int, int]]], top: int):
    """Split a text of characters up to ``top`` into words, numbers, signs and spaces."""
    letter, number = _class(ranges["L"], top), _class(ranges["N"], top)
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+"
        f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall


class Words(dict):
    """Word -> packed ids (little-endian, 32 bits each); unknown words are encoded by ``_path`` and kept."""

    def __init__(self, data: dict, ranges: dict[str, list[tuple[int, int]]]) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in data.get("added_tokens", [])}
        marks = "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.marks = re.compile(f"({marks})") if marks else None
        self.split_ascii, self.split_plane, self.split_all = (splitter(ranges, top) for top in (0x7F, 0xFFFF, 0x10FFFF))
        self.astral = re.compile("[\U00010000-\U0010ffff]").search

    def _path(self, raw: bytes) -> list[int]:
        """Tokens of one word."""
        raise NotImplementedError

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            path = self._path(word.encode("utf-8", "surrogatepass"))
            packed = array("I", path).tobytes() if LITTLE else b"".join(t.to_bytes(4, "little") for t in path)
        if len(word) <= 64:
            if 2 * len(self) >= WORDS_KEPT:
                self.older = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            words = self.split_ascii(text)
        elif self.astral(text) is None:
            words = self.split_plane(text)
        else:
            words = self.split_all(text)
        return b"".join(map(self.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text; strings of added tokens become those tokens."""
        if self.marks is None or not any(mark in text for mark in self.added):
            return self._plain(text)
        return b"".join(self.added.get(part) or self._plain(part) for part in self.marks.split(text) if part)


class Library(Words):
    """The same with the words' tokens from the tokenizers library, which workers need then."""

    def __init__(self, definition: str, ranges: dict[str, list[tuple[int, int]]]) -> None:
        from tokenizers import Tokenizer
        super().__init__(json.loads(definition), ranges)
        self.tokens = Tokenizer.from_str(definition).model.tokenize
        self.letters = {byte: letter for letter, byte in byte_letters().items()}

    def _path(self, raw: bytes) -> list[int]:
        return [token.id for token in self.tokens(raw.decode("latin-1").translate(self.letters))]


class Automaton(Words):
    """The same by the automaton; it decodes too."""

    def __init__(self, definition: str, ranges: dict[str, list[tuple[int, int]]]) -> None:
        data = json.loads(definition)
        super().__init__(data, ranges)
        letters = byte_letters()
        vocabulary = data["model"]["vocab"]
        self.labels: dict[int, bytes] = {i: bytes(map(letters.__getitem__, t)) for t, i in vocabulary.items()}
        self.first = [vocabulary[letter] for letter, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.right: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.gates: dict[int, int] = {}
        self.steps: dict[int, bool] = {}
        for step, pair in enumerate(data["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self._gadget(step, vocabulary[a], vocabulary[b], vocabulary[a + b])
        alive = {self.labels[token]: token for token in {*self.first, *self.born}}
        self.lengths = {token: len(label) for label, token in alive.items()}
        self.shorter: dict[int, int] = {}
        for label, token in alive.items():
            for end in range(len(label) - 1, 0, -1):
                if label[:end] in alive:
                    self.shorter[token] = alive[label[:end]]
                    break
        import ahocorasick
        self.arcs = ahocorasick.Automaton()
        for label, token in alive.items():
            self.arcs.add_word(label.decode("latin-1"), token)
        self.arcs.make_automaton()
        self.labels |= {t["id"]: t["content"].encode() for t in data.get("added_tokens", [])}

    def _gadget(self, step: int, u: int, v: int, uv: int) -> None:
        if not self._accepts(u, v):
            return  # no path has u before v any more, so the merge never applies
        self.gates[u << 20 | v] = step
        self.left[uv], self.right[uv], self.born[uv] = u, v, step

    def _accepts(self, last: int, token: int) -> bool:
        """Whether the state behind ``last`` has an arc ``token``."""
        gates, chain, until = self.gates, last, NEVER
        while True:
            label, born = token, NEVER
            while True:
                at = gates.get(chain << 20 | label)
                if at is not None and at < until and at <= born:
                    return False
                if label not in self.left:
                    break
                born, label = self.born[label], self.left[label]
            if chain not in self.right:
                return True
            until, chain = self.born[chain], self.right[chain]

    def _path(self, raw: bytes) -> list[int]:
        size, steps, lengths, shorter, longest, line = len(raw), self.steps, self.lengths, self.shorter, self.arcs.iter_long, raw.decode("latin-1")
        if len(steps) >= STEPS_KEPT:
            steps.clear()
        path: list[int] = []
        at, dead = 0, set()
        while at < size:
            # The longest arcs from here on, as far as each may follow the one before.
            for _, token in longest(line, at):
                if path:
                    key = path[-1] << 20 | token
                    goes = steps.get(key)
                    if goes is None:
                        goes = steps[key] = self._accepts(path[-1], token)
                    if not goes:
                        break
                if at + lengths[token] in dead:
                    break
                path.append(token)
                at += lengths[token]
            else:
                break
            goes = False
            while not goes:
                token = shorter.get(token)
                while token is None:  # no arc leads on from here, so the last arc was wrong
                    dead.add(at)
                    token = path.pop()
                    at -= lengths[token]
                    token = shorter.get(token)
                goes = at + lengths[token] not in dead
                if goes and path:
                    key = path[-1] << 20 | token
                    goes = steps.get(key)
                    if goes is None:
                        goes = steps[key] = self._accepts(path[-1], token)
            path.append(token)
            at += lengths[token]
        return path

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become replacement characters."""
        ids = memoryview(packed).cast("I")
        if not LITTLE:
            ids = [int.from_bytes(packed[i:i + 4], "little") for i in range(0, len(packed), 4)]
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


def definition(path: str) -> str:
    """Text of a vocabulary file (a few MB, whatever the corpus), read once on the driver."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def shipped(spark: SparkSession, path: str, kind: type[Words] = Automaton):
    """A function for tasks that gives the automaton of ``path`` (or another ``kind`` of words), compiled once per worker."""
    text = definition(path)
    key = f"bpe-{kind.__name__}-" + hashlib.sha256(text.encode()).hexdigest()
    sent = spark.sparkContext.broadcast((text, categories()))
    return lambda: worker_table(key, lambda: kind(*sent.value))


def _mapped(df: DataFrame, make, added: list[tuple[str, str]]) -> DataFrame:
    """``df`` with columns of ``added`` made batch by batch; columns of these names are replaced."""
    names = {n for n, _ in added}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} {t}" for n, t in added)])

    def run(batches):
        work = make()
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays(columns + work(batch), names=[f.name for f in kept] + [n for n, _ in added])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``n_tokens`` and ``packed_ids`` (little-endian unsigned 32-bit ids) of each whole text.

    A null text counts as empty (no ids, empty binary). Every row gives one row, repeated rows
    too. Columns that already have these names are replaced; all others stay.
    """
    automaton = shipped(df.sparkSession, path)

    def make():
        tables = automaton()

        def work(batch):
            packed = [tables.encode(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            return [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]

        return work

    return _mapped(df, make, [("n_tokens", "bigint"), ("packed_ids", "binary")])


def decode(df: DataFrame, path: str, packed: str = "packed_ids") -> DataFrame:
    """Adds ``decoded``, the text of packed ids; null ids count as none."""
    automaton = shipped(df.sparkSession, path)

    def make():
        tables = automaton()
        return lambda batch: [pa.array(
            [tables.decode(p or b"") for p in batch.column(batch.schema.get_field_index(packed)).to_pylist()], pa.string())]

    return _mapped(df, make, [("decoded", "string")])


def encode_decode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``encode`` and then ``decode`` in one pass over the rows."""
    automaton = shipped(df.sparkSession, path)

    def make():
        tables = automaton()

        def work(batch):
            packed = [tables.encode(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            return [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary()),
                    pa.array([tables.decode(p) for p in packed], pa.string())]

        return work

    return _mapped(df, make, [("n_tokens", "bigint"), ("packed_ids", "binary"), ("decoded", "string")])
