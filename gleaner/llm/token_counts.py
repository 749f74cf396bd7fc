"""Token counts by a compiled tokenizer: a deterministic transducer over characters, run over chunks whose state maps are composed.

A byte-pair vocabulary of scored pieces cuts a text in one way, and the cut of a prefix is known without what follows it: its last
piece is the one that ends there and may stand after the last piece of the prefix before it. Two pieces may stand side by side if
their joined text is cut into just those two. So the tokenizer is a transducer: a state holds, for every place from which a piece
may still reach further, what has been read since, the last piece before that place and how many tokens fewer there were; a
transition carries how many tokens the next character adds (also less than none, when a longer piece takes up shorter ones).
Where no piece holds two neighbouring characters side by side the state depends on the next character alone. The vocabulary is
compiled once per Python worker; states are made when a text first reaches them, as in the subset construction of a pattern
matcher, kept for later tasks, and thrown away between blocks once there are `most_states`.

All texts of a block are cut into chunks of equal length. Every chunk is run at once from a cold start (one step of all chunks
per character). The chunk's state map sends every entry state that meets the cold run inside the chunk to the same exit state, and
adds a count known at the meeting place; so the entry states of all chunks follow by one shift, maps of chunks without a meeting
place pass the state on, and the counts of a text are the sums over its chunks.

No shuffle: a row's result depends on the row. A task holds one block of characters, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm.shared import give_back, short_batches

SPACE = "▁"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FREE = np.int64(-1)


class Pieces:
    """The vocabulary of a sentencepiece byte-pair model with byte fallback: scores of pieces, and which cuts are its own."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(model.get_piece_size())
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in ids
                     if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        probe = "  ﬁ Å ½　x\t "
        if model.normalize(probe) != (SPACE + probe).replace(" ", SPACE) or not any(model.is_byte(i) for i in ids):
            raise ValueError(f"{model_path}: only models that keep texts as they are, put a space first and fall back to bytes are compiled")
        whole = [p for p in self.rank if self.cut(p) == [p]]
        self.pieces = set(whole)
        self.heads = {p[:k] for p in whole for k in range(len(p))}
        self.pairs = {p[k:k + 2] for p in whole for k in range(len(p) - 1)}
        self.beside: dict[tuple[str, str], bool] = {}

    def cut(self, text: str) -> list[str]:
        """The tokens of a short text by its merges: best score first, then leftmost."""
        parts = list(text)
        while True:
            merges = [(self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank]
            if not merges:
                return parts
            i = min(merges)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def may_follow(self, last: str, piece: str) -> bool:
        if not last or last[-1] + piece[0] not in self.pairs:
            return True
        known = self.beside.get((last, piece))
        if known is None:
            known = self.beside[last, piece] = self.cut(last + piece) == [last, piece]
        return known


class Transducer:
    """States and transitions as arrays. Classes 1 to 4: characters that join with none, with that many tokens; then the others."""

    def __init__(self, model_path: str, most_states: int = 250_000):
        self.vocabulary = Pieces(model_path)
        self.most_states = most_states
        self.joining = sorted({c for pair in self.vocabulary.pairs for c in pair})
        every = np.arange(0x110000)
        self.classes = (1 + (every > 0x7F) + (every > 0x7FF) + (every > 0xFFFF)).astype(np.int16)
        single = [ord(p) for p in self.vocabulary.pieces if len(p) == 1]
        self.classes[single] = 1
        self.classes[[ord(c) for c in self.joining]] = np.arange(5, 5 + len(self.joining))
        self.width = 5 + len(self.joining)
        # a joining character that is no piece itself costs its bytes until a merge takes it up: no vocabulary here has one
        if any(c not in self.vocabulary.pieces for c in self.joining):
            raise ValueError(f"{model_path}: a piece holds a character that is no piece")
        number = {c: 5 + i for i, c in enumerate(self.joining)}
        self.joined = np.zeros((self.width, self.width), bool)
        for a, b in self.vocabulary.pairs:
            self.joined[number[a], number[b]] = True
        self.cost = np.minimum(np.arange(self.width), 4).astype(np.int64)
        self.cost[5:] = 1
        self.clear()

    def clear(self) -> None:
        """No states but those after one character that nothing is joined to; state 0 stands after a class of its own."""
        self.states: list[tuple] = [()]
        self.numbers: dict[tuple, int] = {}
        self.vocabulary.beside.clear()
        self.known: dict[tuple[int, int], tuple[int, int]] = {}
        self.held = 0
        self.keys = np.full(1 << 16, _FREE)
        self.to = np.zeros(len(self.keys), np.int32)
        self.adds = np.zeros(len(self.keys), np.int8)
        self.start = np.zeros(self.width, np.int32)
        for i, c in enumerate(self.joining):
            self.start[5 + i] = self._state(self._read((("", "", 0),), c)[0])

    def _state(self, live: tuple) -> int:
        number = self.numbers.setdefault(live, len(self.states))
        if number == len(self.states):
            self.states.append(live)
        return number

    def _read(self, live: tuple, c: str) -> tuple[tuple, int]:
        """What is live after one more character, and the tokens it adds."""
        v = self.vocabulary
        for read, last, fewer in live:
            if read + c in v.pieces and v.may_follow(last, read + c):
                piece, adds = read + c, fewer + 1
                break
        on = tuple((read + c, last, fewer - adds) for read, last, fewer in live if read + c in v.heads)
        return (*on, ("", piece, 0)), adds

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is held, or the free slot where it belongs."""
        mask = np.int64(len(self.keys) - 1)
        slots = ((keys.astype(np.uint64) * _ODD) >> np.uint64(40)).astype(np.int64) & mask
        held = self.keys[slots]
        on = np.flatnonzero((held != keys) & (held != _FREE))
        while len(on):
            slots[on] = (slots[on] + 1) & mask
            held = self.keys[slots[on]]
            on = on[(held != keys[on]) & (held != _FREE)]
        return slots

    def _learn(self, keys: np.ndarray) -> None:
        """Transitions for new keys (state * width + class); room first, so that half the slots stay free."""
        if 2 * (self.held + len(keys)) > len(self.keys):
            full = self.keys != _FREE
            old = self.keys[full], self.to[full], self.adds[full]
            size = len(self.keys)
            while 2 * (self.held + len(keys)) > size:
                size *= 4
            self.keys, self.to, self.adds = np.full(size, _FREE), np.zeros(size, np.int32), np.zeros(size, np.int8)
            self._put(*old)
        to, adds = np.empty(len(keys), np.int32), np.empty(len(keys), np.int8)
        for i, key in enumerate(keys.tolist()):
            state, c = divmod(key, self.width)
            live, adds[i] = self._read(self.states[state], self.joining[c - 5])
            to[i] = self._state(live)
        self._put(keys, to, adds)
        self.held += len(keys)

    def _put(self, keys: np.ndarray, to: np.ndarray, adds: np.ndarray) -> None:
        while len(keys):
            slots, one = np.unique(self._slots(keys), return_index=True)
            self.keys[slots], self.to[slots], self.adds[slots] = keys[one], to[one], adds[one]
            rest = np.ones(len(keys), bool)
            rest[one] = False
            keys, to, adds = keys[rest], to[rest], adds[rest]

    def step(self, states: np.ndarray, classes: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One character for every run: the next states and the tokens added."""
        to, adds = self.start[classes], self.cost[classes]
        at = np.flatnonzero(joined)
        if len(at):
            keys = states[at].astype(np.int64) * self.width + classes[at]
            slots = self._slots(keys)
            new = self.keys[slots] != keys
            if new.any():
                self._learn(np.unique(keys[new]))
                slots = self._slots(keys)
            to[at], adds[at] = self.to[slots], self.adds[slots]
        return to, adds

    def counts(self, codes: np.ndarray, first: np.ndarray, carried: tuple[int, int], chunk: int = 128) -> tuple[np.ndarray, tuple[int, int]]:
        """Tokens of each text of a block (code points in a row, where each text starts). The first text may be the rest of one
        whose (last class, state) is carried over; the same is returned for the end of the block."""
        if len(self.states) > self.most_states:
            # the carried state has to live on
            live = self.states[carried[1]]
            self.clear()
            carried = carried[0], self._state(live)
        n = len(codes)
        classes = self.classes[codes]
        joined = np.empty(n, bool)
        joined[1:] = self.joined[classes[:-1], classes[1:]]
        joined[first] = False
        joined[0] = self.joined[carried[0], classes[0]]
        lanes = -(-n // chunk)
        grid = np.zeros(lanes * chunk, np.int16)
        grid[:n] = classes
        grid = np.ascontiguousarray(grid.reshape(lanes, chunk).T)
        link = np.zeros(lanes * chunk, bool)
        link[:n] = joined
        link = np.ascontiguousarray(link.reshape(lanes, chunk).T)
        # cold runs of all chunks
        states, adds = np.empty((chunk, lanes), np.int32), np.empty((chunk, lanes), np.int32)
        at = np.zeros(lanes, np.int32)
        for k in range(chunk):
            at, adds[k] = self.step(at, grid[k], link[k] if k else np.zeros(lanes, bool))
            states[k] = at
        ends = states[-1].copy()
        if n % chunk:
            ends[-1] = states[n % chunk - 1, -1]
        # heads: from the entry state until the cold run is met
        entry = np.concatenate([[carried[1]], ends[:-1]]).astype(np.int32)
        lane = np.flatnonzero(link[0])
        at = entry[lane]
        for k in range(chunk):
            if not len(lane):
                break
            at, more = self.step(at, grid[k, lane], link[k, lane])
            adds[k, lane] = more
            apart = (at != states[k, lane]) & (lane * chunk + k < n)
            states[k, lane] = at
            lane, at = lane[apart], at[apart]
        # chunks that never met theirs hand their state on, one after another
        for i in sorted(set(lane.tolist())):
            while i < lanes:
                state = states[-1, i]
                i += 1
                if i >= lanes or not link[0, i] or self._follow(state, i, grid, link, states, adds, n - i * chunk):
                    break
        per = adds.T.reshape(-1)[:n]
        last = n - 1
        return np.add.reduceat(per, first, dtype=np.int64), (int(classes[last]), int(states[last % chunk, last // chunk]))

    def _follow(self, state: int, lane: int, grid: np.ndarray, link: np.ndarray, states: np.ndarray, adds: np.ndarray, left: int) -> bool:
        """Runs one chunk from a state; true where it meets the run it has."""
        size = min(len(grid), left)
        had = states[:size, lane].tolist()
        for k, (c, on) in enumerate(zip(grid[:size, lane].tolist(), link[:size, lane].tolist())):
            if not on:
                return True                                 # from here on the cold run is right
            found = self.known.get((state, c))
            if found is None:
                to, more = self.step(np.array([state], np.int32), grid[k, lane:lane + 1], link[k, lane:lane + 1])
                found = self.known[state, c] = int(to[0]), int(more[0])
            state, adds[k, lane] = found
            if had[k] == state:
                return True
            states[k, lane] = state
        return False


_COMPILED: dict[str, Transducer] = {}


def compiled(model_path: str) -> Transducer:
    """The transducer of a model, one per Python process."""
    if model_path not in _COMPILED:
        _COMPILED[model_path] = Transducer(model_path)
    return _COMPILED[model_path]


def token_counts(texts: list[str | None], machine: Transducer, block: int = 1 << 20) -> np.ndarray:
    """Tokens of every text (null and empty: none), in blocks of `block` characters that texts may run across."""
    out = np.zeros(len(texts), np.int64)
    parts, rows, size = [], [], 0
    carried = (0, 0)

    def flush() -> None:
        nonlocal carried, size
        if parts:
            codes = np.frombuffer("".join(parts).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)
            first = np.cumsum([0, *map(len, parts[:-1])])
            found, carried = machine.counts(codes, first, carried)
            np.add.at(out, rows, found)
            parts.clear(), rows.clear()
            size = 0

    for row, text in enumerate(texts):
        at = -1                                             # the space put first
        while text and at < len(text):
            piece = (SPACE if at < 0 else "") + text[max(at, 0):at + block - size]
            if not parts and at < 0:
                carried = (0, 0)
            parts.append(piece), rows.append(row)
            at += len(piece)
            size += len(piece)
            if size >= block:
                flush()
    flush()
    return out


def with_token_counts(docs: DataFrame, model_path: str, *, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """`docs` with the number of tokens that sentencepiece gives for the text, without begin, end or other added tokens.

    Null and empty texts have none. Rows are counted each on their own, so repeated rows and ids of any kind do not matter; other
    columns stay, and one named as `out` is replaced. Strings of control pieces in a text are ordinary text. Texts of any length
    are counted whole.
    """
    short_batches(docs.sparkSession)
    kept = docs.drop(out) if out != text_col else docs
    place = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model_path)
        for b in batches:
            n = pa.array(token_counts(b.column(place).to_pylist(), machine), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n], [*b.schema.names, out])
        give_back()

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{kind}, `{out}` long")
