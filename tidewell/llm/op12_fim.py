"""Fill-in-middle: texts are cut into prefix, middle and suffix at ends of lines, by one table-driven scan of their bytes.

The automaton reads bytes. A state says how many UTF-8 continuation bytes are outstanding, whether a unit begins here,
and how much of a sentinel has been read; a table gives the next state for each state and byte, and another what the
transition counts: a code point that begins, a unit that ends, a sentinel that is complete.

A batch is scanned once. Texts are cut into blocks, and all blocks go forward together, a byte at a step, in numpy. The
state in which a block other than a text's first begins is not known yet, so it is run from every state; the blocks of a
text are then chained, each from the state in which the one before it ended. What is kept are counts at block ends.

The second pass locates cuts: counts name the block in which a unit ends, and only those blocks are read again.

Defined results: a null text is empty; an empty text, and one that holds a sentinel, stay as they are (form plain, cuts
null); a null id is an empty number in the draw; rows that repeat an id draw alike; an empty table gives an empty one;
other columns are not looked at, whatever their names. A long text is read whole, in blocks of the same size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bounded_batches, steps, table

SENTINELS = ("<P>", "<S>", "<M>")
BLOCK = 1024
#: Places of the counts in a transition's value: code points that begin, units that end, sentinels that are complete.
POINT, UNIT, SENTINEL = 1, 1 << 20, 1 << 40
MASK = (1 << 20) - 1
SEED, RATE, SPM = 7, 100, 50


class Automaton:
    """The tables for the given sentinels, and what a scan with them finds."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        marks = [s.encode() for s in sentinels]
        begun = {m[:i] for m in marks for i in range(len(m))}  # what has been read of a sentinel, never all of it

        def longest(read: bytes) -> bytes:
            return next(read[i:] for i in range(len(read) + 1) if read[i:] in begun)

        def move(state: tuple[bytes, int, bool], byte: int) -> tuple[tuple[bytes, int, bool], int]:
            read, due, _ = state
            if due and 0x80 <= byte < 0xC0:
                return (longest(read + bytes([byte])), due - 1, False), SENTINEL * any((read + bytes([byte])).endswith(m) for m in marks)
            due = 1 if 0xC0 <= byte < 0xE0 else 2 if 0xE0 <= byte < 0xF0 else 3 if byte >= 0xF0 else 0
            now, ends = read + bytes([byte]), byte == 0x0A
            done = any(now.endswith(m) for m in marks)
            return (longest(b"" if done else now), due, ends), POINT + UNIT * ends + SENTINEL * done

        states, table_, counts = [(b"", 0, True)], [], []
        for state in states:  # grows as new ones are met
            for byte in range(256):
                to, count = move(state, byte)
                if to not in states:
                    states.append(to)
                table_.append(states.index(to) << 8)
                counts.append(count)
        self.next, self.count = np.array(table_, np.int64), np.array(counts, np.int64)
        self.states, self.fresh = len(states), np.array([s[2] for s in states])

    def run(self, b: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Goes forward from all starts together, longest first: (lanes still running, their states, their counts) after each byte."""
        state, count = state.astype(np.int64) << 8, np.zeros(len(start), np.int64)
        live, least = len(start), np.sort(length)
        for i in range(int(length[0]) if len(length) else 0):
            live = len(length) - int(np.searchsorted(least, i, "right"))
            at = state[:live] + b[start[:live] + i]
            state[:live] = self.next[at]
            count[:live] += self.count[at]
            yield live, state, count

    def scan(self, b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts one after another: (first block of each text and the end, state in which each block begins, counts before each block and behind the last).

        Counts run on from text to text."""
        size = np.diff(ends)
        blocks = -(-size // BLOCK)
        first = np.concatenate(([0], np.cumsum(blocks)))
        n = int(first[-1])
        of = np.repeat(np.arange(len(size)), blocks)
        start = ends[of] + (np.arange(n) - first[of]) * BLOCK
        length = np.minimum(ends[of + 1] - start, BLOCK)
        opening = np.arange(n) == first[of]
        tried = np.where(opening, 1, self.states)
        lane = np.concatenate(([0], np.cumsum(tried)))
        block = np.repeat(np.arange(n), tried)
        order = np.argsort(-length[block], kind="stable")
        begin = (np.arange(int(lane[-1])) - lane[block])[order]
        state, count = begin << 8, np.zeros(len(order), np.int64)
        for _, state, count in self.run(b, start[block][order], length[block][order], begin):
            pass
        ended, counted = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        ended[order], counted[order] = state >> 8, count
        entry, before = np.zeros(n + 1, np.int64), np.zeros((n + 1, 3), np.int64)
        now = 0
        for k, (is_first, at) in enumerate(zip(opening.tolist(), lane[:-1].tolist())):
            now = 0 if is_first else now
            entry[k] = now
            now = int(ended[at + now])
        entry[n] = now
        took = counted[lane[:-1] + entry[:-1]]
        before[1:] = np.cumsum(np.stack([took & MASK, took // UNIT & MASK, took // SENTINEL], 1), 0)
        # the state in which a text ends is that of its last block
        last = np.zeros(len(size), np.int64)
        some = blocks > 0
        last[some] = ended[lane[:-1][first[1:][some] - 1] + entry[first[1:][some] - 1]]
        self.open = some & ~self.fresh[last]
        return first, entry, before

    def locate(self, b: np.ndarray, ends: np.ndarray, found: tuple, text: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the unit-th unit of a text ends, in bytes and in code points of the text; the rest of a text without \\n is a unit."""
        first, entry, before = found
        base = before[first[text]]
        units = before[first[text + 1]][:, 1] - base[:, 1]
        at, points = np.where(unit > units, ends[text + 1] - ends[text], 0), np.where(unit > units, before[first[text + 1]][:, 0] - base[:, 0], 0)
        inner = np.flatnonzero((unit > 0) & (unit <= units))
        if len(inner):
            goal = base[inner, 1] + unit[inner]
            block = np.searchsorted(before[:, 1], goal) - 1
            start = ends[text[inner]] + (block - first[text[inner]]) * BLOCK
            length = np.minimum(ends[text[inner] + 1] - start, BLOCK)
            order = np.argsort(-length, kind="stable")
            need = ((goal - before[block, 1]) * UNIT)[order]
            stop, seen = np.full(len(inner), -1), np.zeros(len(inner), np.int64)
            for i, (live, _, count) in enumerate(self.run(b, start[order], length[order], entry[block][order])):
                new = np.flatnonzero((stop[:live] < 0) & ((count[:live] // UNIT & MASK) * UNIT == need[:live]))
                stop[new], seen[new] = i + 1, count[new] & MASK
            back = inner[order]
            at[back] = start[order] + stop - ends[text[back]]
            points[back] = before[block[order], 0] - base[back, 0] + seen
        return at, points


def _draws(ids: list, seed: int) -> np.ndarray:
    """The first four 32-bit groups of each id's digest."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentinels: tuple[str, str, str] = SENTINELS, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for each row: rate of 100 texts are cut, spm of 100 of those in the order suffix, prefix, middle."""
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(sentinels)
        p, s, m = (x.encode() for x in sentinels)
        for batch in batches:
            ids = batch.column(0)
            for i, j, b, ends in steps(batch):
                found = first, _, before = automaton.scan(b, ends)
                total = before[first[1:]] - before[first[:-1]]
                n = total[:, 1] + automaton.open
                h = _draws(ids.slice(i, j - i).to_pylist(), seed)
                plain = (np.diff(ends) == 0) | (total[:, 2] > 0) | (h[:, 2] % 100 >= rate)
                psm = h[:, 3] % 100 >= spm
                a, z = np.sort(h[:, :2] % (n + 1)[:, None], 1).T
                rows = np.flatnonzero(~plain)
                at, points = automaton.locate(b, ends, found, np.concatenate((rows, rows)), np.concatenate((a[rows], z[rows])))
                data, out, forms = b.tobytes(), [], np.where(plain, "plain", np.where(psm, "psm", "spm"))
                chars = np.zeros((j - i, 2), np.int64)
                chars[rows] = np.stack((points[: len(rows)], points[len(rows) :] - points[: len(rows)]), 1)
                cuts = np.zeros((j - i, 2), np.int64)
                cuts[rows] = np.stack((at[: len(rows)], at[len(rows) :]), 1)
                for k, (x, y) in enumerate(cuts.tolist()):
                    t = data[ends[k] : ends[k + 1]]
                    if plain[k]:
                        out.append(t)
                    elif psm[k]:
                        out.append(b"".join((p, t[:x], s, t[y:], m, t[x:y])))
                    else:
                        out.append(b"".join((s, t[y:], p, t[:x], m, t[x:y])))
                yield pa.record_batch(
                    [ids.slice(i, j - i), pa.array(n), pa.array(forms.tolist()), pa.array(chars[:, 0], mask=plain), pa.array(chars[:, 1], mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, f"id {rows.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from which an output of the given form was made; no sentinel occurs in it, nor begins in it and ends behind it."""
    p, s, m = (F.lit(x) for x in sentinels)
    between = lambda a, b: F.substr(output, F.instr(output, a) + F.length(a), F.instr(output, b) - F.instr(output, a) - F.length(a))
    middle = F.substr(output, F.instr(output, m) + F.length(m))
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fim(spark, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
