"""Byte-level BPE by a lazily determinised transducer, and a streaming decoder.

The merges define a function from the bytes of one pre-token to token ids.  Read from left to right, the last token of
every prefix is unique: it is the one vocabulary entry ending there that the merges keep apart from the last token of
the prefix before it.  So a state need only remember the last certain token and the bytes after it; certain means that
every token that could still end later begins behind it.  Tokens leave after a lookahead of at most the longest
vocabulary entry.  A pre-token adds at most one transition, where it leaves the known ones, so that states are made for
beginnings that come again; behind it the same steps are taken without being kept.  A step follows one automaton of all
suffixes that begin a vocabulary entry (Aho and Corasick's, its transitions found when they are first taken) and tries
the entries that end there.  The number of states is bounded, and they are learnt anew after very many such walks, so
that memory is bounded for any text.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array

import regex
from pyspark.sql import DataFrame

from farstray.llm.common import small_batches, tidy, worker_tables

OUTPUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: Bytes that are walked without states before what is certain leaves.
AHEAD = 1024
#: States are learnt anew after so many walks a state.
RELEARN = 32


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line of base64 bytes and a number for each token."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_all(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The definition: join the pair of lowest rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Transducer:
    """Pre-token bytes to packed little-endian 32-bit ids.

    A state is the last certain token and the bytes after it.  With each state go the node of the longest suffix of those
    bytes that begins a vocabulary entry, and the last tokens of all prefixes of those bytes: their starts and ids.  Where
    the start is before those bytes no later token can begin, and it is never looked at.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = 50_000):
        self.ranks = ranks
        self.most_states = most_states
        self.kept_apart: dict[int, bool] = {}
        self._make_trie()
        self._make_merges()
        self._clear()

    def _make_trie(self) -> None:
        """For each node its depth, the node of its longest shorter suffix (``fail``) and the vocabulary entries that end
        there (length and id, the longest first); 0 is the root."""
        self.next_node: dict[int, int] = {}
        token_of, self.depth, arcs = array("i", [-1]), array("i", [0]), array("q", [0])
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                at = node << 8 | byte
                to = self.next_node.get(at, 0)
                if not to:
                    to = self.next_node[at] = len(token_of)
                    token_of.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    arcs.append(at)
                node = to
            token_of[node] = rank
        self.fail = array("i", [0]) * len(arcs)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(arcs)
        for node in sorted(range(1, len(arcs)), key=self.depth.__getitem__):
            before, byte = arcs[node] >> 8, arcs[node] & 255
            self.fail[node] = self._suffix(before, byte) if before else 0
            shorter = self.ends[self.fail[node]]
            self.ends[node] = ((self.depth[node], token_of[node]), *shorter) if token_of[node] >= 0 else shorter
        self.most_nodes = len(self.next_node) + 2 * self.most_states

    def _suffix(self, node: int, byte: int) -> int:
        """The node of the longest suffix, shorter than that of ``node``, that ``byte`` prolongs."""
        while node:
            node = self.fail[node]
            if (to := self.next_node.get(node << 8 | byte)) is not None:
                return to
        return 0

    def _make_merges(self) -> None:
        """For each token the two tokens whose merge makes it: those that lower merges make and leave apart."""
        ranks = self.ranks
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[int, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is None or right is None or i > 1 and left > rank or i < len(token) - 1 and right > rank:
                    continue
                if self._stay(left, right):
                    self.halves[rank] = (left, right)
                    self.joined[left << 32 | right] = rank
                    break
            else:
                if len(token) > 1:
                    raise ValueError(f"no merge of the vocabulary makes {token!r}")

    def _clear(self) -> None:
        self.at: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.states: list[tuple[int, bytes, int, array, array]] = [(-1, b"", 0, array("i", [0]), array("i", [-1]))]
        self.next: dict[int, tuple[int, bytes]] = {}
        self.final: dict[int, bytes] = {}
        self.walks = 0

    def _apart(self, left: int, right: int) -> bool:
        """Whether the merges leave two tokens as they are when they stand side by side.

        They don't if, at some time, the rightmost part of the left and the leftmost part of the right would be joined
        before a merge inside either of them: both are taken apart, always the one that was merged last.
        """
        if len(self.kept_apart) > 4 * self.most_states:
            self.kept_apart.clear()
        known = self.kept_apart[left << 32 | right] = self._stay(left, right)
        return known

    def _stay(self, left: int, right: int) -> bool:
        limit = 1 << 60  # the rank of the merge last undone; a tie goes to the leftmost pair
        while True:
            made = self.joined.get(left << 32 | right)
            if made is not None and made < limit:
                return False
            in_left, in_right = self.halves.get(left), self.halves.get(right)
            if in_left is None and in_right is None:
                return True
            # single bytes have no merge; the later of two merges is undone first
            if in_right is None or in_left is not None and left > right:
                limit, left = left, in_left[1]
            else:
                limit, right = right + 1, in_right[0]

    def _walk(self, starts: list, tokens: list, node: int, more: bytes) -> int:
        """Append the last token of each prefix that ``more`` adds; the node behind it."""
        next_node, ends, known_apart, apart = self.next_node, self.ends, self.kept_apart.get, self._apart
        n = len(starts)
        for byte in more:
            to = next_node.get(node << 8 | byte)
            if to is None:
                to = self._suffix(node, byte)
                if len(next_node) < self.most_nodes:
                    next_node[node << 8 | byte] = to
            node = to
            for length, token in ends[node]:
                start = n - length
                left = tokens[start]
                if left < 0 or (fits := known_apart(left << 32 | token)) or fits is None and apart(left, token):
                    break
            else:
                raise ValueError(f"the vocabulary can't spell byte {byte} here")
            starts.append(start)
            tokens.append(token)
            n += 1
        return node

    def _settle(self, starts: list, tokens: list, node: int) -> tuple[int, bytes, list, list]:
        """How many bytes are certain, their ids, and the starts and tokens behind them."""
        # certain is where the ways back from the end and from every place where a later token may begin first meet
        n = cut = len(starts) - 1
        while node and cut:
            j, node = n - self.depth[node], self.fail[node]
            while cut != j:
                if cut > j:
                    cut = starts[cut]
                else:
                    j = starts[j]
        if not cut:
            return 0, b"", starts, tokens
        return cut, self._ids(starts, tokens, cut), [0, *(max(start - cut, 0) for start in starts[cut + 1 :])], tokens[cut:]

    @staticmethod
    def _ids(starts: list, tokens: list, at: int) -> bytes:
        """The ids of the first ``at`` bytes."""
        ids = []
        while at > 0:
            ids.append(tokens[at])
            at = starts[at]
        ids.reverse()
        return array("I", ids).tobytes()

    def _step(self, state: int, byte: int) -> tuple[int, bytes]:
        before, pending, node, starts, tokens = self.states[state]
        pending, starts, tokens = pending + bytes((byte,)), starts.tolist(), tokens.tolist()
        node = self._walk(starts, tokens, node, pending[-1:])
        cut, out, starts, tokens = self._settle(starts, tokens, node)
        if cut:
            before, pending = tokens[0], pending[cut:]
        key = (before, pending)
        if key not in self.at:
            self.at[key] = len(self.states)
            self.states.append((before, pending, node, array("i", starts), array("i", tokens)))
        return self.at[key], out

    def _rest(self, state: int, rest: bytes) -> bytes:
        """What ``rest`` and the end add after ``state``, without new states; a piece of it at a time, so that memory is bounded."""
        _, _, node, starts, tokens = self.states[state]
        starts, tokens, out = starts.tolist(), tokens.tolist(), []
        if len(rest) <= AHEAD:
            self._walk(starts, tokens, node, rest)
            return self._ids(starts, tokens, len(starts) - 1)
        for at in range(0, len(rest), AHEAD):
            if at:
                _, sure, starts, tokens = self._settle(starts, tokens, node)
                out.append(sure)
            node = self._walk(starts, tokens, node, rest[at : at + AHEAD])
        out.append(self._ids(starts, tokens, len(starts) - 1))
        return b"".join(out)

    def encode(self, piece: bytes) -> bytes:
        if piece in self.ranks:  # as the library does, also for an entry that its own merges can't reach
            return array("I", [self.ranks[piece]]).tobytes()
        if self.walks > RELEARN * self.most_states:
            self._clear()
        state, out, arcs, grown = 0, [], self.next, len(self.states) >= self.most_states
        for at, byte in enumerate(piece):
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                if grown:
                    self.walks += 1
                    out.append(self._rest(state, piece[at:]))
                    return b"".join(out)
                grown = True
                arc = arcs[state << 8 | byte] = self._step(state, byte)
            state = arc[0]
            if arc[1]:
                out.append(arc[1])
        if state not in self.final:
            _, _, _, starts, tokens = self.states[state]
            self.final[state] = self._ids(starts, tokens, len(starts) - 1)
        out.append(self.final[state])
        return b"".join(out)


def _utf8_arcs() -> list[bytes]:
    """For each state of the automaton the next one by byte.

    A state is what may come next: a character's begin (0), one to three continuation bytes (1 to 3) or one of four second bytes of
    narrower range (after E0, ED, F0, F4: 4 to 7); 8 is an error.
    """
    wrong = 8
    arcs = [bytearray([wrong]) * 256 for _ in range(9)]
    begin = [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)]
    later = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
    for low, high, to in begin:
        arcs[0][low : high + 1] = bytes([to]) * (high + 1 - low)
    for state, (low, high, to) in later.items():
        arcs[state][low : high + 1] = bytes([to]) * (high + 1 - low)
    return [bytes(a) for a in arcs]


HIGH = re.compile(rb"[\x80-\xff]+")


class Utf8Stream:
    """Whole characters of a byte stream whose pieces may end within one, by an automaton that is driven by the bytes.

    The state of the automaton and the bytes of an unfinished character, at most three, are all that is kept.  Runs of
    ASCII leave the state as it is and are passed over at once.  Bytes that are in no character become U+FFFD as text and stay what they are as bytes.
    """

    ARCS = _utf8_arcs()

    def __init__(self) -> None:
        self.state, self.rest, self.wrong = 0, b"", 0

    def feed_bytes(self, piece: bytes) -> bytes:
        """The bytes of the characters that are certain now."""
        whole = self.rest + piece
        arcs, state, begin, at, wrong = self.ARCS, self.state, 0, len(self.rest), self.wrong
        for run in HIGH.finditer(whole, at):
            if run.start() > at and state:  # an unfinished character before ASCII
                state, wrong = 0, wrong + 1
            begin = begin if state else run.start()
            for at in range(run.start(), run.end()):
                byte = whole[at]
                state = arcs[state][byte]
                if state == 0:
                    begin = at + 1
                elif state == 8:
                    # what came before is no character; the byte itself may begin one
                    wrong += 1
                    state = arcs[0][byte] if at > begin else 8
                    begin = at if state < 8 else at + 1
                    state %= 8
            at = run.end()
        if at < len(whole):
            begin, state, wrong = len(whole), 0, wrong + (state > 0)
        self.state, self.rest, self.wrong = state, whole[begin:], wrong
        return whole[:begin]

    def feed(self, piece: bytes) -> str:
        return self.feed_bytes(piece).decode("utf-8", "replace")

    def close_bytes(self) -> bytes:
        last, self.state, self.rest = self.rest, 0, b""
        return last

    def close(self) -> str:
        return self.close_bytes().decode("utf-8", "replace")


class Codec:
    """Splits texts into pre-tokens, encodes each, and decodes id streams.

    Pre-tokens met lately are kept in two generations of bounded size; what is met again moves to the younger one.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_cached: int = 120_000):
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern)
        self.bytes_of: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.most_cached = most_cached
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _missed(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.transducer.encode(piece.encode("utf-8"))
        if len(piece) < 64:
            self.cache[piece] = ids
            if len(self.cache) >= self.most_cached:
                self.older = dict(self.cache)
                self.cache.clear()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, missed = self.cache.get, self._missed
        # findall makes a list of all pieces, which is faster but holds a very long text several times
        pieces = self.split.findall(text) if len(text) < 1_000_000 else (m.group() for m in self.split.finditer(text))
        return b"".join([known(p) or missed(p) for p in pieces])

    def decode(self, ids: bytes, step: int = 65_536):
        """The bytes of the text in pieces of whole characters, as they become certain."""
        stream, bytes_of = Utf8Stream(), self.bytes_of.__getitem__
        for at in range(0, len(ids), 4 * step):
            yield stream.feed_bytes(b"".join(map(bytes_of, array("I", ids[at : at + 4 * step]))))
        yield stream.close_bytes()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text.

    Per row: the key, the number of tokens and SHA-256 digests of the ids and of the decoded bytes; with
    ``keep_ids`` also ``ids``, an array of ints.  A null text is an empty one; repeated rows stay repeated; other
    columns are ignored whatever their names.  No shuffle: rows are independent.
    """
    schema = OUTPUT.replace("doc_id long", f"`{key}` {docs.schema[key].dataType.simpleString()}") + (", ids array<int>" if keep_ids else "")

    def run(batches):
        # one for each Python worker, for all its tasks
        codec = worker_tables((ranks_path, pattern), lambda: Codec(read_ranks(ranks_path), pattern))
        gc.disable()  # the tables hold very many objects and no cycles
        try:
            yield from encoded(codec, batches)
        finally:
            gc.enable()

    def encoded(codec, batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for value in batch.column(1):
                ids = codec.encode(value.as_py() or "")
                decoded = hashlib.sha256()
                for piece in codec.decode(ids):
                    decoded.update(piece)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest(), array("I", ids) if keep_ids else None))
            columns = [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array([r[3] for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(docs.sparkSession)

    return docs.select(key, text).mapInArrow(tidy(run, (ranks_path, pattern)), schema)
