"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled texts: lower-cased UTF-8, each
run of ASCII bytes that are no letters as one blank. A text is parsed from its
start into the fewest longest matches with the automaton, across words; the number
of phrases times log2 of the automaton's text size, over the number of symbols,
estimates the cross-entropy, and the language with the lowest estimate wins. Many
stretches of `STRETCH` symbols are parsed side by side, so a match ends at the end
of a stretch too.

Training reads a bounded sample: about `sample_rows` labelled rows of each
language, by a hash of the id, and their whole texts. Symbols are bytes, so an
automaton's table has at most 256 columns whatever the alphabet; only states with
several successors have a row of it. A worker's memory grows with the number of
languages and with `sample_rows`.

Defined results: a text that is null or has no letter is `und` with score 0;
equal estimates go to the first language by name; if nothing was learned, every
text is `und`; repeated rows get equal results; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructType

from quadrille.llm.kernel import buffers, byte_class, slices

SAMPLE_ROWS = 50
#: Symbols that are parsed in one go.
STRETCH = 512
#: Bits of cross-entropy a symbol that change the odds by a factor of e**8.
SHARPNESS = 8.0
BLANK = 0x20
_LETTERS = byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_ASCII_LETTERS = byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B)])


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, one after the other, and where each text's start (with the end)."""
    data, off = buffers(pc.utf8_lower(column))
    inside = _LETTERS[data]
    # a blank stands before each word, and none behind the last
    keep = inside.copy()
    first = np.zeros(len(data), bool)
    first[off[:-1][off[:-1] < off[1:]]] = True
    before = np.append(False, inside[:-1]) & ~first
    start = inside & ~before
    count = np.cumsum(keep.astype(np.int64) + start)
    out = np.full(int(count[-1]) if len(count) else 0, BLANK, np.uint8)
    out[count[keep] - 1] = data[keep]
    return out, np.append(0, count)[off] if len(count) else np.zeros(len(off), np.int64)


def lettered(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, off = buffers(column)
    total = lambda mask: np.append(0, np.cumsum(mask))
    ascii_letters, high = total(_ASCII_LETTERS[data]), total(data >= 0x80)
    out = ascii_letters[off[1:]] > ascii_letters[off[:-1]]
    for i in np.flatnonzero(~out & (high[off[1:]] > high[off[:-1]])).tolist():
        out[i] = any(c.isalpha() for c in column[i].as_py())
    return out


class SuffixAutomaton:
    """Of several texts (bytes); after `freeze` as arrays."""

    def __init__(self, texts: list[bytes]):
        edges, link, longest = [{}], [-1], [0]
        self.size = 0
        for text in texts:
            last = 0
            self.size += len(text)
            for s in text:
                if s in edges[last]:  # a prefix that is already there
                    q = edges[last][s]
                    last = q if longest[q] == longest[last] + 1 else self._clone(edges, link, longest, last, q, s)
                    continue
                cur, p = len(edges), last
                edges.append({})
                link.append(0)
                longest.append(longest[last] + 1)
                while p >= 0 and s not in edges[p]:
                    edges[p][s] = cur
                    p = link[p]
                if p >= 0:
                    q = edges[p][s]
                    link[cur] = q if longest[q] == longest[p] + 1 else self._clone(edges, link, longest, p, q, s)
                last = cur
        self._freeze(edges)

    @staticmethod
    def _clone(edges, link, longest, p, q, s) -> int:
        new = len(edges)
        edges.append(dict(edges[q]))
        link.append(link[q])
        longest.append(longest[p] + 1)
        link[q] = new
        while p >= 0 and edges[p].get(s) == q:
            edges[p][s] = new
            p = link[p]
        return new

    def _freeze(self, edges: list[dict[int, int]]) -> None:
        """`symbol`, `target`: the successor of a state with one; `row`, `dense`: the successors of the others."""
        known = sorted({s for e in edges for s in e})
        self.column = np.zeros(256, np.int32)  # column 0: a symbol that never comes
        self.column[known] = np.arange(1, len(known) + 1)
        several = [i for i, e in enumerate(edges) if len(e) > 1 or not i]
        self.symbol, self.target, self.row = (np.zeros(len(edges), x) for x in (np.uint8, np.int32, np.int32))  # no symbol is 0
        self.row[several] = np.arange(1, len(several) + 1)  # row 0: no successor
        self.dense = np.full((len(several) + 1, len(known) + 1), -1, np.int32)
        for k, i in enumerate(several, 1):
            self.dense[k, self.column[list(edges[i])]] = list(edges[i].values())
        for i, e in enumerate(edges):
            if len(e) == 1 and i:
                ((s, to),) = e.items()
                self.symbol[i], self.target[i] = s, to

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.symbol, self.target, self.row, self.dense))

    def phrases(self, lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each lane; lanes: symbols by position and lane, lanes in descending order of length."""
        n = len(lengths)
        state, count = np.zeros(n, np.int32), np.zeros(n, np.int64)
        width = self.dense.shape[1]
        flat, root = self.dense.ravel(), self.dense[1]
        live = np.searchsorted(-lengths, -np.arange(1, lanes.shape[0] + 1), "right")  # lanes that reach each position
        for j in range(lanes.shape[0]):
            m = int(live[j])
            at, symbol = state[:m], lanes[j, :m]
            column = self.column[symbol]
            to = np.where(self.symbol[at] == symbol, self.target[at], flat[self.row[at].astype(np.int64) * width + column])
            fail = np.flatnonzero(to < 0)
            if len(fail):
                again = root[column[fail]]
                # the phrase that ends here, and a symbol that the language does not know
                count[fail] += (at[fail] != 0).astype(np.int64) + (again < 0)
                to[fail] = np.maximum(again, 0)
            state[:m] = to
        return count + (state != 0)


class Model:
    """One automaton for each language, sorted by name."""

    def __init__(self, automata: dict[str, SuffixAutomaton]):
        self.languages = sorted(automata)
        self.automata = [automata[x] for x in self.languages]
        self.bits = np.log2(np.array([max(2, a.size) for a in self.automata], float))

    def totals(self, column: pa.Array) -> np.ndarray:
        """For each text: symbols, then phrases in each language."""
        data, off = symbols(column)
        n = len(column)
        pieces = -(-np.diff(off) // STRETCH)
        row = np.repeat(np.arange(n), pieces)
        begin = off[row] + STRETCH * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        length = np.minimum(STRETCH, off[row + 1] - begin)
        by = np.argsort(-length, kind="stable")
        row, begin, length = row[by], begin[by], length[by]
        longest = int(length[0]) if len(length) else 0
        padded = np.append(data, np.zeros(STRETCH, np.uint8))
        lanes = padded[begin[None, :] + np.arange(longest)[:, None]] if longest else np.zeros((0, 0), np.uint8)
        out = np.zeros((n, len(self.automata) + 1))
        out[:, 0] = np.diff(off)
        for k, automaton in enumerate(self.automata, 1):
            out[:, k] = np.bincount(row, weights=automaton.phrases(lanes, length), minlength=n)
        return out


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    import pickle

    data, off = symbols(table["text"].combine_chunks())
    raw = data.tobytes()
    automaton = SuffixAutomaton(sorted(raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)))
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "automaton": pa.array([pickle.dumps(automaton)], pa.binary())})


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on (id, text, language) rows; rows without a language are left out."""
    import pickle

    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return Model({})
    every = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, max(1, n // sample_rows))])
    sample = rows.where(F.pmod(F.xxhash64("id"), F.element_at(every, F.col("lang"))) == 0)
    # a task for each language: building takes a second or more
    built = sample.select("lang", "text").repartition(len(counts), "lang").groupBy("lang").applyInArrow(_build, "lang string, automaton binary")
    found = {r[0]: pickle.loads(r[1]) for r in built.collect()}  # one automaton a language, of the sample's size
    return Model({k: v for k, v in found.items() if v.size})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", sharpness: float = SHARPNESS) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return with_language(rows, model, "lang_pred", "score", "text", sharpness, drop_text=True)


def with_language(docs: DataFrame, model: Model, lang_name: str, score_name: str, text_col: str = "text", sharpness: float = SHARPNESS, drop_text: bool = False) -> DataFrame:
    """All columns and the language and score of each row, in one pass without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if not (drop_text and f.name == text_col)]
    schema = StructType(kept).add(lang_name, StringType()).add(score_name, DoubleType())
    arrow, place = to_arrow_schema(schema), [f.name for f in docs.schema.fields].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = [*model.languages, "und"]
        for batch in slices(batches, text_col):
            column = batch.column(place)
            best, score = np.full(len(column), len(names) - 1), np.zeros(len(column))
            known = lettered(column)
            if model.languages and known.any():
                totals = model.totals(column)[known]
                bits = totals[:, 1:] * model.bits / totals[:, :1]
                best[known] = bits.argmin(1)
                score[known] = 1 / np.exp(-sharpness * (bits - bits.min(1, keepdims=True))).sum(1)
            columns = [c for i, c in enumerate(batch.columns) if not (drop_text and i == place)]
            columns += [pa.array([names[i] for i in best.tolist()], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(run, schema)
