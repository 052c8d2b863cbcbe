"""Token counts by a compiled finite-state transducer.

The public tokenizer cuts a text into pieces (runs of letters, single digits, runs of other marks) and merges the
bytes of a piece by rank. Read from left to right that is a deterministic transducer. Its state keeps, for every
suffix of the bytes read so far that still begins some token, the token which ends before that suffix and how many
tokens lie from there to here: all that the next byte needs. A byte leads to the one state whose last token may
follow the token before it, and the transition is annotated with the tokens it emits (the change of the piece's
count); a second annotation is the emission where the byte ends its piece, as word ends are tokens of their own.
Whether two tokens may be neighbours follows from the ranks. States are numbered and compiled when first reached,
in a table of at most ``STATES`` rows; past it the table is begun anew, which changes no result.

A text is cut into chunks at any byte. All chunks of a batch run in lockstep, one look-up in the table for each
byte. A chunk gives a state map: for each state that may stand before it, the state after it and the tokens emitted.
The domain is closed in rounds: first the start state, then what earlier chunks can end in. A chunk with a piece end
maps all states to one; others mostly do, since a state is recent context. The maps of a text compose by state number
in a parallel prefix scan. A map holds numbers, never bytes, so that a text without any white space needs no more
memory than others.

Words with bytes outside ASCII and the letters of Latin-1, and those with apostrophes, ``<`` or ``|`` (contractions,
special strings), are no input of the table: the library counts them one by one.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a text of any length is read whole; special strings
inside a text are matched as the tokenizer does by default (they hold no white space); repeated rows give repeated
rows; an empty table gives no rows; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textio

#: Bytes of a chunk, bytes of a batch, rows of the transition table, odd words whose counts a task keeps.
CHUNK, BATCH, STATES, ODD_WORDS = 1024, 4 << 20, 150_000, 50_000
#: Columns of the table: of letters (a-z, xC3, x80-xBF after it), or of marks and digits.
WIDTH = 64
IDLE = 0
_WHITE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, column and lower case of every byte; continuation bytes are looked at with the byte before them."""
    kind, column, lower = np.full(256, _ODD, np.uint8), np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    kind[MARKS], column[MARKS] = _MARK, np.arange(10, 10 + len(MARKS))
    for b in b"'<|":
        kind[b] = _ODD
    for i in range(26):
        kind[97 + i] = kind[65 + i] = _LETTER
        column[97 + i] = column[65 + i] = i
        lower[65 + i] = 97 + i
    for i in range(10):
        kind[48 + i], column[48 + i] = _DIGIT, i
    kind[0xC3], column[0xC3] = _LETTER, 26
    for b in range(0x80, 0xC0):
        column[b] = 27 + (b - 0x80) % 32 if b >= 0xA0 else 27 + 31 if b == 0x9F else 27 + b - 0x80
    kind[list(textio.WHITE)] = _WHITE
    return kind, column, lower


KIND, COLUMN, LOWER = _byte_tables()


def _printable() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """Tokens of the vocabulary as numbers, the ranks of their merges, and which may be neighbours."""

    END = "</w>"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.pair: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.pair[x, y], self.rank[z], self.halves[z] = r, r, (x, y)
        self.begins = {(s := t[:i]): s for t in self.ids for i in range(1, len(t) + 1)}
        self.known: dict[tuple[int, int], bool] = {}

    def neighbours(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay apart when the bytes of both are merged by rank: undo the later merge of the
        two sides again and again; no pair across the border may have been due before."""
        got = self.known.get((a, b))
        if got is None:
            if len(self.known) > 400_000:
                self.known.clear()
            got = self.known[a, b] = self._apart(a, b)
        return got

    def _apart(self, a: int, b: int) -> bool:
        due = len(self.pair)
        while True:
            if self.pair.get((a, b), due) < due:
                return False
            x, y = self.rank.get(a, -1), self.rank.get(b, -1)
            if x < 0 and y < 0:
                return True
            if x > y:
                due, a = min(due, x), self.halves[a][1]
            else:
                due, b = min(due, y + 1), self.halves[b][0]


class Transducer:
    """The compiled table. A machine's state is a row's first cell plus the column of the byte read last, whose
    transition waits for the next byte: it differs where the piece ends. Cells hold the next row's first cell
    and both emissions. State 0 is between pieces."""

    def __init__(self, path: str, most: int = STATES):
        from tokenizers import Tokenizer

        self.merges, self.most = Merges(path), most
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.symbols = _printable()
        self.of_odd: dict[bytes, int] = {}
        self.compiled = 0
        self.begin_anew()

    def begin_anew(self) -> None:
        """Rows: 0 idle, 1 start of letters, 2 start of digits and marks. A row's state is flat: whether it is of
        letters, then for each open suffix the suffix, the token before it (-1: none) and the tokens since, negative."""
        self.rows: list[tuple] = [(), (True, "", -1, 0), (False, "", -1, 0)]
        self.number = {self.rows[1]: 1, self.rows[2]: 2}
        # Zeroed memory is not touched before it is used. next: one more than the next row's first cell, 0 if not compiled.
        cells = (self.most + (1 << 15)) * WIDTH
        self.next, self.step, self.last = np.zeros(cells, np.int32), np.zeros(cells, np.int8), np.zeros(cells, np.int8)
        self.next[:WIDTH] = 1

    def _byte(self, column: int, letters: bool) -> str:
        if letters:
            return self.symbols[97 + column if column < 26 else 0xC3 if column == 26 else 0x9F if column == 27 + 31 else 0xA0 + column - 27]
        return self.symbols[48 + column] if column < 10 else self.symbols[MARKS[column - 10]]

    def compile(self, cell: int) -> None:
        """Fills one cell of the table: the next state, and what the byte emits inside and at the end of a piece."""
        row, column = divmod(cell, WIDTH)
        state = self.rows[row]
        c = self._byte(column, state[0])
        token, step = self._token(state, c)
        # An open suffix of the longer text: it begins a token, with the token before it and the tokens since.
        after = [state[0]]
        for i in range(1, len(state), 3):
            if (longer := self.merges.begins.get(state[i] + c)) is not None:
                after += (longer, state[i + 1], state[i + 2] - step)
        after = (*after, "", token, 0)
        at = self.number.get(after)
        if at is None:
            at = self.number[after] = len(self.rows)
            self.rows.append(after)
            if len(self.rows) * WIDTH > len(self.next):
                self.next, self.step, self.last = (np.concatenate([x, np.zeros(len(x) // 2, x.dtype)]) for x in (self.next, self.step, self.last))
        self.step[cell], self.last[cell] = step, self._token(state, c + self.merges.END)[1]
        self.next[cell] = at * WIDTH + 1
        self.compiled += 1

    def _token(self, state: tuple, c: str) -> tuple[int, int]:
        """The last token once c is read, and the change of the count."""
        m = self.merges
        for i in range(1, len(state), 3):
            token = m.ids.get(state[i] + c)
            if token is not None and (state[i + 1] < 0 or m.neighbours(state[i + 1], token)):
                return token, state[i + 2] + 1
        raise ValueError("no token fits; the vocabulary lacks a byte")

    def odd_counts(self, words: list[bytes]) -> list[int]:
        """Counts of words that the table does not read, from the library."""
        known = self.of_odd
        new = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(new) > ODD_WORDS:
            known.clear()
            new = list(dict.fromkeys(words))
        counts = [len(e.ids) for at in range(0, len(new), 256) for e in self.library.encode_batch_fast([w.decode("utf-8", "replace") for w in new[at : at + 256]], add_special_tokens=False)]
        fresh = dict(zip(new, counts, strict=True))
        out = [fresh[w] if w in fresh else known[w] for w in words]
        known.update((w, n) for w, n in fresh.items() if len(w) <= 256)
        return out

    def run(self, column: np.ndarray, begins: np.ndarray, at: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs lanes over bytes at..end from their states, in lockstep: states after, and tokens emitted.

        column: of each byte, 255 for white space and odd words; begins: whether a byte begins a piece (or follows one's end)."""
        order = np.argsort(at - end, kind="stable")
        at, length, state = at[order], (end - at)[order], state[order].astype(np.int64)
        emitted = np.zeros(len(at), np.int64)
        n = int(np.count_nonzero(length > 0))
        for j in range(int(length[0]) if n else 0):
            while n and length[n - 1] <= j:
                n = int(np.searchsorted(-length, -j, "left"))
            p = at[:n] + j
            col, new = column[p], begins[p]
            s = state[:n]
            self.ensure(s)
            emitted[:n] += np.where(new, self.last[s], self.step[s])
            s = np.where(new, self.start[col >> 6], self.next[s] - 1)
            state[:n] = np.where(col == 255, IDLE, s + (col & 63))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], emitted[back]

    #: First cell of the start row by the two upper bits of a column: letters, digits and marks, unused, white space.
    start = np.array([WIDTH, 2 * WIDTH, 0, 0], np.int64)

    def ensure(self, states: np.ndarray) -> None:
        """Compiles the cells of these states that are not compiled yet."""
        missing = states[self.next[states] == 0]
        if len(missing):
            for cell in np.unique(missing).tolist():
                self.compile(cell)

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All texts as one row of bytes: columns, beginnings of pieces, tokens of odd words by text, offsets."""
        at = textio.spans(map(len, texts))
        raw = np.frombuffer(b"".join(texts), np.uint8)
        kind, low = KIND[raw], LOWER[raw]
        if len(raw) > 1:
            second = np.flatnonzero(raw[:-1] == 0xC3) + 1
            x = raw[second]
            fine = (x != 0x97) & (x != 0xB7)
            kind[second] = np.where(fine, _LETTER, _ODD)
            low[second] = np.where(fine & (x < 0x9F), x + 0x20, x)
        column = COLUMN[low]
        column[(kind == _DIGIT) | (kind == _MARK)] |= 64
        begins = np.ones(len(raw), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begins[at[:-1][at[:-1] < len(raw)]] = True
        odd_tokens = np.zeros(len(texts), np.int64)
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):
            # Words are cut by white space and by the ends of texts.
            cut = kind == _WHITE
            first = np.zeros(len(raw), bool)
            first[0], first[1:] = True, cut[:-1]
            first[at[:-1][at[:-1] < len(raw)]] = True
            first &= ~cut
            starts = np.flatnonzero(first)
            word = np.unique(np.searchsorted(starts, odd, "right") - 1)
            a = starts[word]
            stops = np.flatnonzero(cut)
            follow = np.searchsorted(stops, a)
            b = np.append(stops, len(raw))[follow]
            doc = np.searchsorted(at, a, "right") - 1
            b = np.minimum(b, at[doc + 1])
            whole = raw.tobytes()
            counts = self.odd_counts([whole[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            odd_tokens += np.bincount(doc, counts, len(texts)).astype(np.int64)
            inside = np.zeros(len(raw) + 1, np.int64)
            np.add.at(inside, a, 1)
            np.add.at(inside, b, -1)
            kind[np.cumsum(inside[:-1]) > 0] = _WHITE
        white = kind == _WHITE
        column[white], begins[white] = 255, True
        begins[1:][white[:-1]] = True
        return column, begins, odd_tokens, at

    def counts(self, texts: list[bytes], chunk: int = CHUNK) -> np.ndarray:
        """Tokens of each text."""
        if len(self.rows) > self.most:
            self.begin_anew()
        column, begins, out, at = self.read(texts)
        size = np.diff(at)
        many = -(-size // chunk)
        text = np.repeat(np.arange(len(texts)), many)
        if not len(text):
            return out
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        a = at[:-1][text] + nth * chunk
        b = np.minimum(a + chunk, at[1:][text])
        # Where a state before the chunk stops mattering: at its first beginning of a piece.
        marks = np.append(np.flatnonzero(begins), len(column))
        head = np.minimum(marks[np.searchsorted(marks, a)], b)
        # Round 1: from between pieces. What the chunk does from its first beginning on, for any state before it.
        fresh = begins.copy()
        fresh[a] = True
        ends, emitted = self.run(column, fresh, a, b, np.zeros(len(a), np.int64))
        has = head < b
        from_head = emitted.copy()
        part = np.flatnonzero(has & (head > a))
        if len(part):
            # The idle run's first piece ends at the head, with its own last emission.
            before, lost = self.run(column, fresh, a[part], head[part], np.zeros(len(part), np.int64))
            self.ensure(before)
            from_head[part] -= lost + self.last[before]
        maps: list[dict[int, tuple[int, int]]] = [{IDLE: (int(e), int(n))} for e, n in zip(ends, emitted, strict=True)]
        todo_chunk = np.flatnonzero(nth[1:] > 0) + 1
        todo_state = ends[todo_chunk - 1]
        while len(todo_chunk):
            c = todo_chunk
            s, n = self.run(column, begins, a[c], head[c], todo_state)
            self.ensure(s)
            n = n + np.where(has[c], self.last[s] + from_head[c], 0)
            s = np.where(has[c], ends[c], s)
            more: list[tuple[int, int]] = []
            for k, x, y, z in zip(c.tolist(), todo_state.tolist(), s.tolist(), n.tolist(), strict=True):
                maps[k][x] = y, z
                if k + 1 < len(maps) and nth[k + 1] and y not in maps[k + 1]:
                    more.append((k + 1, y))
            more = list(dict.fromkeys(more))
            todo_chunk = np.array([k for k, _ in more], np.int64)
            todo_state = np.array([x for _, x in more], np.int64)
        first = 0
        finals = np.zeros(len(texts), np.int64)
        for t in np.flatnonzero(many).tolist():
            final, n = scan(maps[first : first + many[t]])[-1][IDLE]
            finals[t] = final
            out[t] += n
            first += int(many[t])
        self.ensure(finals)
        return out + self.last[finals]


def compose(a: dict[int, tuple[int, int]], b: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """State map of a, then b; b knows every state that a leads to."""
    return {x: (b[y][0], n + b[y][1]) for x, (y, n) in a.items() if y in b}


def scan(maps: list[dict[int, tuple[int, int]]]) -> list[dict[int, tuple[int, int]]]:
    """Inclusive prefix scan by doubling: log2(n) rounds of independent compositions."""
    step = 1
    while step < len(maps):
        maps = [compose(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
        step *= 2
    return maps


_MACHINES: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each file and Python worker."""
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(path)
    return _MACHINES[path]


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of docs (columns doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in textio.slices(batches, 1, BATCH):
            texts = textio.as_bytes(batch.column(1))
            n = np.zeros(len(texts), np.int64)
            for rows, parts in textio.parts_of(texts, BATCH):
                np.add.at(n, rows, machine.counts(parts, chunk))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    return textio.map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    counted = token_counts(textio.table(spark, sf_dir, "documents"), textio.tokenizer_path(textio.WORD_TOKENIZER))
    return counted.withColumn("over_limit", counted.n_tokens > 2048)
