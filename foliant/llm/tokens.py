"""Byte-level BPE as a lazily determinised transducer, streaming decoding, and cached coding of texts."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import held, small_batches, tidy_keeping

#: Unicode white space, as the pre-tokenizer understands it (fixed values).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space with what follows it. No match of the pre-tokenizer's pattern goes from
#: other characters into white space, so the parts of a text can be coded on their own.
PART = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Where a long text may be cut: white space after another character.
SEAM = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
#: Texts of these characters alone are split alike by every Unicode version.
SETTLED = re.compile("[\t\n\r -~\xa1-\u017f]*")
#: The split of byte-level tokenizer files that use the built-in pattern (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Coded pieces that a worker keeps in each of two generations, with the library and beside the transducer, their longest, and determinised states.
MOST_PIECES, BESIDE, LONGEST, MOST_STATES = 700_000, 200_000, 64, 400_000
#: Characters of a text that are split at once.
SEGMENT = 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a vocabulary file of lines ``base64 rank``."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class BpeTransducer:
    """Codes one match of the pre-tokenizer byte by byte.

    A sequence of tokens is what the merges give for its bytes exactly if the merges leave
    every two neighbours apart. The nondeterministic machine therefore holds the last token
    and a place in the trie of tokens; at the end of a token it may take it, if the merges
    keep it apart from the last one. A determinised state is what is still possible, oldest
    place first, each with the tokens on which it differs from the rest; tokens that all
    agree on are emitted. No possibility lives longer than the longest token, which bounds
    both the lookahead and the states' size. Of the ways to end at one byte only one is what
    the merges give, so a state has one possibility that stands between tokens: its last.
    States and steps are made when first met; when there are too many, all are forgotten.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        # how each token came about: the two tokens of its last merge
        self.halves: dict[int, tuple[int, int]] = {}
        # the trie: the place after (place, byte), whether a place goes on, and the token that ends there
        self.next: dict[int, int] = {}
        self.goes_on = [False]
        self.ends: list[int | None] = [None]
        rising = True
        for token, i in ranks.items():
            parts = self._merged(token, i)
            if parts is None:
                continue  # no merges lead to it; only a whole match can be this token
            if len(parts) == 2:
                self.halves[i] = ranks[parts[0]], ranks[parts[1]]
                rising &= all(len(p) == 1 or ranks[p] < i for p in parts)
            place = 0
            for b in token:
                after = self.next.get(place << 8 | b)
                if after is None:
                    after = self.next[place << 8 | b] = len(self.ends)
                    self.goes_on[place] = True
                    self.goes_on.append(False)
                    self.ends.append(None)
                place = after
            self.ends[place] = i
        # merges come in the order of their ranks if none makes a token of a lesser rank than its parts
        self.rising = rising
        self._reset()

    def _reset(self, held: tuple = ((-1, 0, ()),)) -> None:
        self.apart: dict[int, bool] = {}
        self.sets = [((-1, 0, ()),)]
        self.numbers = {self.sets[0]: 0}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._number(held)

    def _number(self, state: tuple) -> int:
        at = self.numbers.get(state)
        if at is None:
            at = self.numbers[state] = len(self.sets)
            self.sets.append(state)
        return at

    def _merged(self, token: bytes, i: int) -> list[bytes] | None:
        """The two parts of a token before its last merge, itself if it is one byte, or nothing if merges make other tokens of it."""
        if len(token) == 1:
            return [token]
        parts = self._merge(token, i)
        return parts if len(parts) == 2 and all(p in self.ranks for p in parts) else None

    def _merge(self, piece: bytes, below: int) -> list[bytes]:
        """The parts of a short piece by merging the best-ranked neighbours of a rank under ``below``."""
        get = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of a short piece by all its merges."""
        return [self.ranks[p] for p in self._merge(piece, 1 << 60)]

    def keeps_apart(self, a: int, b: int) -> bool:
        """Whether the merges leave two neighbours as they are.

        Merges are undone from the last to the first. Whatever stood left and right of the
        seam until the merge of rank ``limit`` would have merged before it, had their own
        rank been less; of equals the left one is first.
        """
        if not self.rising:
            return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        get, text, halves = self.ranks.get, self.bytes_of, self.halves
        limit = 1 << 60
        while True:
            if get(text[a] + text[b], limit) < limit:
                return False
            left, right = halves.get(a), halves.get(b)
            if left is not None and (right is None or a > b):
                limit, a = a, left[1]
            elif right is not None:
                limit, b = b + 1, right[0]
            else:
                return True

    def _step(self, state: int, b: int) -> tuple[int, tuple[int, ...]]:
        after, taken = [], None
        get, ends, goes_on, apart = self.next.get, self.ends, self.goes_on, self.apart
        for last, place, rest in self.sets[state]:
            place = get(place << 8 | b)
            if place is None:
                continue
            if goes_on[place]:
                after.append((last, place, rest))
            token = ends[place]
            if token is None or taken is not None:
                continue
            if last >= 0:
                known = apart.get(last << 32 | token)
                if known is None:
                    known = apart[last << 32 | token] = self.keeps_apart(last, token)
                if not known:
                    continue
            taken = token, 0, (*rest, token)
        if taken is None:
            raise ValueError("the vocabulary lacks single bytes")
        after.append(taken)
        n, first = 0, after[0][2]
        while n < len(first) and all(len(rest) > n and rest[n] == first[n] for _, _, rest in after):
            n += 1
        if n:
            after = [(last, place, rest[n:]) for last, place, rest in after]
        at = self._number(tuple(after))
        step = self.steps[state << 8 | b] = at, first[:n]
        return step

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state = 0
        for b in piece:
            step = self.steps.get(state << 8 | b)
            if step is None:
                if len(self.sets) > MOST_STATES:  # go on from this state alone
                    held = self.sets[state]
                    self._reset(held)
                    state = self.numbers[held]
                step = self._step(state, b)
            state, more = step
            if more:
                out += more
        out += self.sets[state][-1][2]
        return out


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return pack(f"<{len(ids)}I", *ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()


class PieceCoder(dict):
    """Little-endian ids by piece of a text; coded when first met, and forgotten by generations.

    When there are ``most``, they become the old generation and the old one goes;
    a piece met again comes back. Pieces over ``LONGEST`` characters are not kept.
    """

    def __init__(self, split, code, most: int):
        super().__init__()
        self.split, self.code, self.most = split, code, most
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = packed(self.code(piece))
        if len(piece) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if len(text) <= SEGMENT:
            return b"".join(map(self.__getitem__, self.split(text)))
        return b"".join(b"".join(map(self.__getitem__, self.split(x))) for x in segments(text))


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """A text cut where white space follows other characters, after ``size`` characters or more."""
    at = 0
    while at < len(text):
        seam = SEAM.search(text, at + size)
        end = seam.start() if seam else len(text)
        yield text[at:end]
        at = end


def bpe_coder(ranks: dict[bytes, int], pattern: str) -> PieceCoder:
    machine = BpeTransducer(ranks)
    return PieceCoder(regex.compile(pattern).findall, lambda piece: machine.encode(piece.encode()), BESIDE)


def json_coder(path: str, most: int = MOST_PIECES) -> PieceCoder:
    """A coder of a tokenizers file; the strings of special tokens are ordinary text.

    Where the file splits by the built-in pattern, settled texts are split so before the
    library codes each piece; it meets the parts of other texts whole.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    kind = made.get("pre_tokenizer") or {}
    built_in = made.get("normalizer") is None and kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
    split = regex.compile(BYTE_LEVEL).findall

    def pieces(text: str) -> list[str]:
        if not built_in:
            return PART.findall(text)
        if SETTLED.fullmatch(text):
            return split(text)
        return [x for part in PART.findall(text) for x in (split(part) if SETTLED.fullmatch(part) else (part,))]

    return PieceCoder(pieces, lambda piece: own.encode(piece, add_special_tokens=False).ids, most)


class Utf8Stream:
    """Decodes ids as they come; what is yielded never ends inside a character.

    The state of the byte machine is what continuation bytes it awaits: a tuple of the
    ranges still allowed, empty between characters. Steps over whole tokens are made from
    byte steps when first met and kept by state. A byte that cannot follow starts anew, so
    damaged input passes through as it is.
    """

    REST = (0x80, 0xBF)

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.steps: dict[tuple, dict[int, tuple]] = {}
        self.state: tuple = ()
        self.tail = b""

    @classmethod
    def _byte(cls, state: tuple, b: int) -> tuple:
        if state and state[0][0] <= b <= state[0][1]:
            return state[1:]
        if 0xC2 <= b <= 0xDF:
            return (cls.REST,)
        if 0xE0 <= b <= 0xEF:
            return ((0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF), cls.REST)
        if 0xF0 <= b <= 0xF4:
            return ((0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF), cls.REST, cls.REST)
        return ()

    def _open(self, data: bytes) -> int:
        """Bytes at the end that belong to a character not yet complete."""
        back = 1
        while back < 4 and back <= len(data) and data[-back] & 0xC0 == 0x80:
            back += 1
        return min(back, len(data))

    def feed(self, ids: Iterable[int]) -> bytes:
        ids = list(ids)
        state = self.state
        for i in ids:
            own = self.steps.get(state)
            if own is None:
                own = self.steps[state] = {}
            after = own.get(i)
            if after is None:
                after = state
                for b in self.tokens[i]:
                    after = self._byte(after, b)
                own[i] = after
            state = after
        self.state = state
        data = self.tail + b"".join(map(self.tokens.__getitem__, ids))
        cut = len(data) - (self._open(data) if state else 0)
        self.tail = data[cut:]
        return data[:cut]

    def finish(self) -> bytes:
        data, self.tail, self.state = self.tail, b"", ()
        return data


def decode(ids: np.ndarray, tokens: dict[int, bytes], stream: Utf8Stream | None = None, step: int = 1 << 16) -> Iterator[bytes]:
    stream = stream or Utf8Stream(tokens)
    for at in range(0, len(ids), step):
        yield stream.feed(ids[at : at + step].tolist())
    yield stream.finish()


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each text, with ``outputs`` also ``ids, decoded``.

    ids are little-endian unsigned 32-bit numbers in a binary column; decoded is what the
    streaming decoder makes of them. A null text is the empty one, without tokens. The
    vocabulary file is read where the work is done, from the same path on every machine.
    """

    @tidy_keeping
    def run(batches):
        coder = held((ranks_path, pattern), lambda: bpe_coder(load_ranks(ranks_path), pattern))
        tokens = held((ranks_path, "bytes"), lambda: {i: t for t, i in load_ranks(ranks_path).items()})
        stream = held((ranks_path, "stream"), lambda: Utf8Stream(tokens))
        for batch in small_batches(batches):
            ids = [coder.encode(x or "") for x in batch.column(1).to_pylist()]
            decoded = [b"".join(decode(np.frombuffer(x, "<u4"), tokens, stream)) for x in ids]
            sha = [[hashlib.sha256(x).hexdigest() for x in column] for column in (ids, decoded)]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *(pa.array(x, pa.string()) for x in sha)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if outputs:
                columns += [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * outputs
    return chosen.mapInArrow(run, kinds)
