"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text knows every substring of it. A text is cut, from left to right,
into the longest phrases that the automaton knows; the fewer phrases a symbol, times the bits of a place in the labelled
text, the closer the text is to the language (the cross-entropy estimate of Ziv and Merhav). One numpy step moves many
stretches of text by one symbol each; where a stretch began inside a phrase of the one before, its first phrases are
parsed again from the state that the one before ended in, until both parses agree. In texts that repeat themselves they
may never agree: stretches that are still due after a few turns are parsed in order, and such as were met before in the
same state are looked up. The count is that of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import column, flat, release

#: Bound of the labelled sample: so many rows and code points in all, dealt evenly to the languages, at least one row each.
#: Rows are whole; only where a language has no row within its share, one row gives a stretch of that length.
SAMPLE_ROWS, SAMPLE_LONGEST = 96, 160_000
#: Languages that are learned: those with the most rows.
LABELS = 1024
#: Turns in which stretches are parsed again side by side; stretches that are looked up.
TURNS, MET = 3, 4096
#: Symbols in one stretch, and stretches parsed together.
STRETCH, TOGETHER = 256, 2048
UNKNOWN = "und"

#: Bytes to symbols: a-z are 1 to 26, every other ASCII byte is the separator 0, bytes above 127 are themselves.
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = np.arange(128, 256)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, runs of separators as one, and the texts' offsets in them."""
    s = _SYMBOL[data]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    keep[offsets[:-1][offsets[:-1] < len(s)]] = True
    return s[keep], np.searchsorted(np.flatnonzero(keep), offsets)


class Automaton:
    """The suffix automaton of one symbol sequence as a table of steps.

    A state is known by the place of its row in the table. A step, at a row's place plus a symbol's code, is twice the next
    state, and one more if the symbol begins a phrase: because no known phrase goes on with it, or in the start state 0,
    which also stands for "after an unknown symbol".
    """

    def __init__(self, text: np.ndarray) -> None:
        step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text.tolist():
            now = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = now
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:  # split the state: its longest strings stay, the shorter ones get a state of their own
                    copy = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[now] = copy
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
            last = now
        known = np.unique(text)
        behind = len(known) + 1
        self.code = np.full(256, len(known), np.intp)  # unknown symbols share a column without any step
        self.code[known] = np.arange(len(known))
        width, end = len(known) + 2, len(step)
        table = np.zeros((end + 1, width), np.int32)
        for state, steps in enumerate(step):
            for c, to in steps.items():
                table[state, self.code[c]] = to
        begins = table == 0
        table = np.where(begins, table[0], table) * width * 2 + (begins | (np.arange(end + 1) == 0)[:, None])
        table[:, behind] = end * width * 2  # behind the end of a text: to the last state, which stays
        self.table, self.behind = table.astype(np.int32).ravel(), behind
        self.bits = np.log2(max(2, len(text)))

    def _parse(self, grid: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The steps that each column of ``grid`` takes, entered in ``state``."""
        trace, at = np.empty(grid.shape, np.int32), state.copy()
        for t in range(len(grid)):
            at += grid[t]
            np.take(self.table, at, out=trace[t], mode="clip")
            np.right_shift(trace[t], 1, out=at)
        return trace

    def _again(self, grid: np.ndarray, state: np.ndarray, trace: np.ndarray) -> None:
        """Take the steps anew, entered in ``state``, in ``trace``, as far as they differ."""
        live = np.arange(grid.shape[1])
        for t in range(len(grid)):
            step, old = self.table[state + grid[t, live]], trace[t, live]
            trace[t, live] = step
            differ = (step ^ old) > 1
            live, state = live[differ], (step[differ] >> 1).astype(np.intp)
            if not len(live):
                break

    def _in_order(self, grid: np.ndarray, due: np.ndarray, entry: np.ndarray, exits: np.ndarray, counts: np.ndarray, head: np.ndarray) -> None:
        """Parse the due stretches one after another, each from the end of the one before, and those that this changes."""
        table, met, waiting = memoryview(self.table), {}, set(due.tolist())
        for i in range(int(due[0]), grid.shape[1]):
            if i not in waiting or exits[i - 1] == entry[i]:
                continue
            entry[i] = state = int(exits[i - 1])
            codes = grid[:, i].astype(np.uint16)
            key = (state, codes.tobytes())
            if key not in met:
                if len(met) >= MET:
                    met.clear()
                n = 0
                for c in codes.tolist():
                    step = table[state + c]
                    n += step & 1
                    state = step >> 1
                met[key] = state, n
            state, counts[i] = met[key]
            if state != exits[i]:
                exits[i] = state
                if i + 1 < grid.shape[1] and not head[i + 1]:
                    waiting.add(i + 1)

    def phrases(self, symbols_: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases that each text is cut into; texts one after another in ``symbols_``."""
        size = np.diff(offsets)
        n = -(-size // STRETCH)
        of = np.repeat(np.arange(len(size)), n)
        first = offsets[:-1][of] + STRETCH * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
        head = first == offsets[:-1][of]
        out, ended = np.zeros(len(size), np.int64), 0
        for a in range(0, len(of), TOGETHER):
            z = min(a + TOGETHER, len(of))
            place = first[a:z] + np.arange(STRETCH)[:, None]
            grid = np.where(place < offsets[1:][of[a:z]], self.code[symbols_[np.minimum(place, len(symbols_) - 1)]], self.behind)
            entry = np.zeros(z - a, np.intp)
            entry[0] = 0 if head[a] else ended
            trace = self._parse(grid, entry)
            # a text's next stretch is entered in the state that the one before ends in; few stretches then end in another
            due, turns = np.flatnonzero(~head[a + 1 : z]) + 1, 0
            while len(due) and turns < TURNS:
                now = (trace[-1, due - 1] >> 1).astype(np.intp)
                due, now = due[now != entry[due]], now[now != entry[due]]
                part, entry[due] = trace[:, due], now
                self._again(grid[:, due], now, part)
                moved = due[(part[-1] ^ trace[-1, due]) > 1] + 1 if len(due) else due
                trace[:, due] = part
                due = moved[moved < z - a]
                due = due[~head[a + due]]
                turns += 1
            counts, exits = (trace & 1).sum(0), (trace[-1] >> 1).astype(np.intp)
            if len(due):
                self._in_order(grid, due, entry, exits, counts, head[a:z])
            ended = int(exits[-1])
            np.add.at(out, of[a:z], counts)
        return out


def score(samples: dict[str, np.ndarray]) -> tuple[list[str], list[Automaton]]:
    names = sorted(samples)
    return names, [Automaton(samples[n]) for n in names]


_built: dict[int, tuple[list[str], list[Automaton]]] = {}


def learn(docs: DataFrame, lang: str = "lang") -> dict[str, np.ndarray]:
    """The labelled sample: symbols of each language, from rows with text and label, by the order of a hash of doc_id.

    Bounded by SAMPLE_ROWS and SAMPLE_LONGEST, whatever the size of ``docs``. Of more than LABELS labels those with the most
    rows are learned, ties to the smaller name.
    """
    own = docs.select("doc_id", F.col(lang).alias("label"), "text").filter(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    own = own.select("label", F.xxhash64(F.lit("sample"), "doc_id").alias("order"), F.xxhash64("text").alias("h"), "text")
    most = [r["label"] for r in own.groupBy("label").count().orderBy(F.col("count").desc(), "label").limit(LABELS).collect()]
    each, share = max(1, SAMPLE_ROWS // max(1, len(most))), max(1, SAMPLE_LONGEST // max(1, len(most)))
    # rows within the share first, so that a long one only stands in where there is no other
    length = F.length("text")
    w = Window.partitionBy("label").orderBy("long", "order", "h")
    first = own.filter(F.col("label").isin(most)).select("label", "order", "h", length.alias("n"), (length > share).cast("int").alias("long"))
    first = first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= each)
    # a few rows a language now
    sum_before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.withColumn("before", sum_before).filter((F.col("rank") == 1) | (F.col("before") + F.col("n") <= share)).select("label", "order", "h")
    # the texts of those rows alone; rows alike in doc_id and text are one
    rows = own.join(F.broadcast(first.distinct().withColumnsRenamed({"label": "l", "order": "o", "h": "g"})), (F.col("label") == F.col("l")) & (F.col("order") == F.col("o")) & (F.col("h") == F.col("g")))
    rows = rows.select("label", "order", "h", F.substring("text", 1, share).alias("text")).dropDuplicates(["label", "order", "h"])
    texts: dict[str, list[tuple[int, int, str]]] = {}
    for r in rows.toLocalIterator():
        texts.setdefault(r["label"], []).append((r["order"], r["h"], r["text"]))
    out = {}
    for label, own_texts in texts.items():
        raw = np.frombuffer(" ".join(t for _, _, t in sorted(own_texts)).encode(), np.uint8)
        out[label] = symbols(raw, np.array([0, len(raw)]))[0]
    return out


def predict(docs: DataFrame, samples: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with lang_pred and lang_score, which are appended to its columns; no shuffle.

    lang_pred: the language of the lowest cross-parsing entropy, ties to the smaller name; ``und`` for null text, text
    without a letter, or when nothing was learned. lang_score: 1 - lowest / second lowest; 1 if there is one language,
    0 for ``und``. Rows that repeat, or have a null doc_id, are rows like others.
    """
    held = docs.sparkSession.sparkContext.broadcast(samples)
    # the row as one column, so that no name of its columns can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    schema = rows.select("whole", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score")).schema
    at = docs.columns.index("text")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple((n, x.tobytes()) for n, x in sorted(held.value.items())))
        if key not in _built:
            _built.clear()
            _built[key] = score(held.value)
        names, automata = _built[key]
        for batch in batches:
            text = column(batch, "whole").field(at)
            s, offsets = symbols(*flat(text))
            size = np.diff(offsets)
            bits = np.full((len(size), max(2, len(automata))), np.inf)
            for k, a in enumerate(automata):
                bits[:, k] = a.phrases(s, offsets) * a.bits / np.maximum(size, 1)
            best = bits.argmin(1)
            two = np.sort(bits, axis=1)[:, :2]
            known = column(batch, "letters").to_numpy(zero_copy_only=False) & bool(automata)
            margin = np.where(np.isinf(two[:, 1]), 1.0, 1 - two[:, 0] / np.where(two[:, 1] > 0, two[:, 1], 1))
            pred = [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "whole"), pa.array(pred, pa.string()), pa.array(np.where(known, np.clip(margin, 0, 1), 0.0))], names=["whole", "lang_pred", "lang_score"])
        release()

    return rows.mapInArrow(parse, schema).select("whole.*", "lang_pred", "lang_score")
