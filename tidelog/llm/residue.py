"""Template residue, filler and error pages in place of content, found by character n-gram models.

Models of hashed character 5-grams are fitted: of natural prose from the whole corpus, by the number of
texts that hold a gram, in which a sentence that may be residue counts once, so that an error page isn't
learnt as prose however many rows hold it; and of residue (unfilled fields, filler, notices of a failing or script-demanding site)
from the rules in seeds.py, which hold no text of any corpus.
The log-likelihood ratio of each residue model to prose is added up over windows; a window whose ratio
exceeds a threshold is residue. Fields have a second model over the shape of the text, in which each
name is one character, so that any name may stand in a field. Passages in quotation marks are quoted,
not residue. Documents are left out by the share of their text that residue covers.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import seeds as seed_texts
from tidelog.llm.texts import slices, spread

GRAM = 5
BITS = 18
#: Window lengths in characters.
WINDOWS = (8, 16, 32)
#: Log-likelihood ratio that a window must exceed, by kind. Were grams independent, prose would exceed t with a
#: probability of less than e^-t, 5e-12 for 26: none in a corpus of 10^11 windows. Fields are told by few
#: characters, so theirs is lower; made-up rulings (tests/llm) and no row of a corpus were looked at for it.
THRESHOLDS = {"field": 11.0, "filler": 26.0, "notice": 26.0}
#: The same for the shape of the text, where a window of three grams holds a field.
SHAPE_WINDOWS = (3, 6)
SHAPE_THRESHOLD = 9.0
#: A quotation is at most this long; text between marks further apart is judged like any other, as a mark that is
#: missing or stray would else hide all that follows it.
LONGEST_QUOTE = 300
#: Log probability below which prose counts as this improbable, so that rare words aren't residue.
FLOOR = -12.0
#: Ratios are kept as whole numbers of 1/UNIT.
UNIT = 64
#: Bounds of a gram's ratio; the few fixed words of fields count for more each.
LEAST, MOST = -4.0, {"field": 8.0, "filler": 5.0, "notice": 5.0}
SHAPE_MOST = 8.0
_CHUNK, _OVERLAP = 1_000_000, 256
#: Log-likelihood ratio a gram from which a sentence may be residue as a whole. What a sentence that isn't suspect
#: loses is nothing; what one that is, and stands in rulings often, loses is its weight as prose.
SUSPECT = 2.5
#: Between texts, longer than any window reaches.
_GAP = "\n" * 40


#: Stands for each character of a quotation.
_HIDDEN = "\ue001"
#: Stands for a name in the seeds of the character model, which is to know the words around it only.
_ANY = "\ue000"
#: Stands before each line while sentences are told apart.
_BREAK = "\ue002"
#: Stands for a number that may differ between copies; those of three digits name an error.
_NUMBER, _NUMBERS = "\ue003", re.compile(r"(?<!\d)(?:\d{1,2}|\d{4,})(?!\d)")
#: What may stand around a field.
_AROUND = ("{}", "{}.", "{},", "{};", "({})", "a: {}", "a {} a", "{} {}", "[1] {}", "1. {}", "(1) {}", "§ 1 {}", "{} [1]", "{} 1.", "{} (1)", "{}. [1]", "{} — a", "— {} —", "| {} |")
#: Fixed value: what makes a shape a field's; brackets count if doubled.
_MARKS = re.compile(r"[{}$#%@<>«»=~]|\[\[|\]\]|__")


def filled(forms: list[str], names: list[str]) -> str:
    """Each form with each name in the place of x."""
    return " ".join(re.sub(r"(?<![^\W_])x(?![^\W_])", n, f) for n in names for f in forms)


def shape_grams() -> list[str]:
    """The shapes' grams that hold a mark; without one, a gram is as likely in prose."""
    marked = [f for f in seed_texts.FIELDS if not re.match(r"\[[^\[%]|\(|[{<]x|__|~~|%x%|@x@|<insert", f)]
    text = plain(filled([c.replace("{}", f) for f in marked for c in _AROUND], ["a"]))
    letters = "".join(map(chr, shape(codes(text))[0].tolist()))
    return [g for g in (letters[i : i + GRAM] for i in range(len(letters) - GRAM + 1)) if _MARKS.search(g)]


def seeds() -> dict[str, str]:
    """The text that each residue model is fitted on."""
    return {"field": filled(seed_texts.FIELDS, [_ANY]), "filler": ". ".join(seed_texts.filler()), "notice": ". ".join(seed_texts.notices())}


_QUOTES = re.compile(
    "„[^„“”\n]{0,%d}[“”]|“[^“”\n]{0,%d}”|« (?:[^«»\n]|«[^«» \n]{1,60}»){0,%d} »|(?<![\\w.])»(?=\\S)[^«»\n]{0,%d}(?<=\\S)«(?!\\w)|(?<!=)\"[^\"<>\n]{0,%d}\"" % ((LONGEST_QUOTE,) * 5)
)


def plain(text: str) -> str:
    """Text without differences of form: NFKC, lower case, single spaces, one at either end; empty if blank."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = " ".join(text.lower().split())
    return f" {text} " if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_M = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0x9E3779B97F4A7C15 * 0x9E3779B97F4A7C15 % 2**64)
_K = np.uint64(0xD6E8FEB86659FD93)


def grams(c: np.ndarray) -> np.ndarray:
    """The hash, below 2^BITS, of the GRAM characters from each position on."""
    n = len(c) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    x = c.astype(np.uint64)
    two = x[:-1] * _M + x[1:]
    h = (two[:n] * _M2 + two[2 : 2 + n]) * _M + x[4 : 4 + n]
    return ((h ^ (h >> np.uint64(31))) * _K >> np.uint64(64 - BITS)).astype(np.int64)


def _classes() -> np.ndarray:
    """For each character below U+3000: 1 for letters and underscores, 2 for digits, else 0."""
    return np.array([1 if chr(i).isalpha() or chr(i) == "_" else 2 if chr(i).isdigit() else 0 for i in range(0x3000)], np.int8)


_CLASS = _classes()
#: For each character below U+0100: 1 for what makes a shape a field's, 2 if it does so doubled, 3 for what a sentence may follow if a space is between.
_SIGNS = np.array([1 if chr(i) in "{}$#%@<>«»=~" else 2 if chr(i) in "[]_" else 3 if chr(i) in ".!?|\n" else 0 for i in range(0x101)], np.int8)


def shape(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a text with each name (letters, underscores, inner dots) as one letter and each number as one digit, and the positions they come from."""
    kind = _CLASS[np.minimum(c, len(_CLASS) - 1)]
    if len(c) > 2:
        kind[1:-1][(c[1:-1] == ord(".")) & (kind[:-2] == 1) & (kind[2:] == 1)] = 1
    at = np.flatnonzero((kind == 0) | (kind != np.append(0, kind[:-1])))
    kind = kind[at]
    return np.where(kind == 1, np.uint32(ord("a")), np.where(kind == 2, np.uint32(ord("1")), c[at])), at


def hide(text: str) -> str:
    """A plain text with each quotation as a run of _HIDDEN."""
    if not any(q in text for q in "“„«»\""):
        return text
    return _QUOTES.sub(lambda m: _HIDDEN * len(m[0]), text)


def _pieces(texts: list[str], overlap: int) -> Iterator[tuple[list[int], list[str]]]:
    """Row numbers with their texts, at most about _CHUNK characters at a time; a longer text in parts that overlap."""
    rows: list[int] = []
    held: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        parts = [t] if len(t) <= _CHUNK else [t[k : k + _CHUNK] for k in range(0, len(t) - overlap, _CHUNK - overlap)]
        for p in parts:
            if held and size + len(p) > _CHUNK:
                yield rows, held
                rows, held, size = [], [], 0
            rows.append(i)
            held.append(p)
            size += len(p)
    if held:
        yield rows, held


def both_counts(text: str) -> np.ndarray:
    """Which grams a plain text has, by hash, and after them those of its shape; 1 for each, however often it has it."""
    c = codes(text)
    return np.concatenate([np.minimum(np.bincount(grams(x), minlength=1 << BITS), 1) for x in (c, shape(c)[0])])


def lined(text: str) -> str:
    """A plain text with a _BREAK and a space where a line begins."""
    return plain(text.replace("\n", f" {_BREAK} ")) if text and not text.isspace() else ""


def sentences(held: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of lined texts, now without breaks and each with a gap behind; where each sentence (or line, or cell between bars) begins, which is the space before it."""
    c = codes(_GAP.join([*held, ""]))
    mark = c == ord(_BREAK)
    keep = ~mark
    keep[1:][mark[:-1] & (c[1:] == ord(" "))] = False
    line = np.append(False, ~keep[:-1])[keep]  # the first character of each line
    c = c[keep]
    sign = _SIGNS[np.minimum(c, len(_SIGNS) - 1)]
    begins = np.append(line[1:], False) | np.append(c[1:] == ord("\n"), False)
    begins[1:] |= sign[:-1] == 3
    begins &= c == ord(" ")
    begins[:1] = True
    return c, np.flatnonzero(begins)


def suspects(c: np.ndarray, g: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of the sentences that begin at ``at``, those that would be residue as a whole were all prose improbable, or hold a mark of fields.

    ``most`` has the ratios of that case. The whole sentence counts, so that prose with some words of the
    seeds isn't suspect. Any sentence that isn't suspect keeps its number in the counts of prose.
    """
    total = np.append(0, np.cumsum(most[g]))
    size = np.maximum(np.diff(np.append(at, len(c))) - (GRAM - 1), 0)
    begin = np.minimum(at, len(g))
    ratio = total[np.minimum(begin + size, len(g))] - total[begin]
    out = (ratio > SUSPECT * UNIT * size) & (ratio > THRESHOLDS["notice"] * UNIT)
    sign = _SIGNS[np.minimum(c, len(_SIGNS) - 1)]
    signs = (sign == 1) | (sign == 2) & np.append(False, c[1:] == c[:-1])
    out[np.searchsorted(at, np.flatnonzero(signs), side="right") - 1] = True
    return np.flatnonzero(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, sentence): in how many texts each gram stands outside suspect sentences, as rows without sentence; the suspect sentences, as rows without gram."""
    most = fit(np.zeros(2 << BITS)).ratios.max(axis=0).astype(np.int64)
    total, place, numbers = np.zeros(2 << BITS, np.int64), np.zeros(1 << BITS, np.int32), np.arange(_CHUNK + 64, dtype=np.int32)
    names = ["gram", "sentence", "n"]
    for b in slices(batches, 4_000_000):
        doubtful: Counter[str] = Counter()
        for _, held in _pieces([lined(t) for t in b.column(1).to_pylist() if t], GRAM - 1):
            c, at = sentences(held)
            g, (s, of) = grams(c), shape(c)
            text, ends = c.tobytes().decode("utf-32-le", "surrogatepass"), np.append(at[1:], len(c))
            found = suspects(c, g, at, most)
            doubtful.update(_NUMBERS.sub(_NUMBER, text[at[i] : ends[i]]) for i in found)
            edge = np.zeros(len(c) + 1, np.int8)
            edge[at[found]] += 1
            edge[ends[found]] -= 1
            inside = np.cumsum(edge[:-1]) > 0
            for i, (x, h, out) in enumerate(((c, g, inside), (s, grams(s), inside[of]))):
                free = ~(out[: len(h)] | out[GRAM - 1 : GRAM - 1 + len(h)])
                gap = x == ord("\n")  # lies behind each text
                begins = np.flatnonzero(~gap & np.append(True, gap[:-1]))
                stops = np.flatnonzero(gap & np.append(False, ~gap[:-1]))
                for low, high in zip(begins.tolist(), stops.tolist()):
                    mine = h[low:high][free[low:high]]
                    order = numbers[: len(mine)]
                    place[mine] = order  # one place of each gram stays
                    total[(i << BITS) + mine[place[mine] == order]] += 1
        yield pa.RecordBatch.from_arrays([pa.nulls(len(doubtful), pa.int32()), pa.array(doubtful.keys(), pa.string()), pa.array(doubtful.values(), pa.int64())], names)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.nulls(len(at), pa.string()), pa.array(total[at])], names)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n) of rows (gram, sentence, n): counts as they are, and the grams of each sentence once; those at a number that may differ are left out."""
    total = np.zeros(2 << BITS, np.int64)
    for b in batches:
        known = b.filter(b.column(0).is_valid())
        np.add.at(total, known.column(0).to_numpy(), known.column(2).to_numpy())
        texts = b.column(1).drop_null().to_pylist()
        for _, held in _pieces(texts, GRAM - 1):
            c = codes(_GAP.join([*held, ""]))
            s, at = shape(np.where(c == ord(_NUMBER), np.uint32(ord("0")), c))
            for i, (x, number) in enumerate(((c, c == ord(_NUMBER)), (s, c[at] == ord(_NUMBER)))):
                h = grams(x)
                bad = number | (x == ord("\n"))
                h = h[~np.logical_or.reduce([bad[k : k + len(h)] for k in range(GRAM)])] if len(h) else h
                total[i << BITS : (i + 1) << BITS] += np.bincount(h, minlength=1 << BITS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])


def prose_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """In how many texts each 5-gram stands, by hash, and each of their shapes: 2^(BITS+1) numbers, however large the corpus.

    Texts count, not occurrences, so that one text full of the same words doesn't make them prose. A
    suspect sentence counts once in all, whatever number of texts has it (numbers in it aside). Sentences
    meet by shuffle, each task's once; none comes to the driver.
    """
    rows = spread(docs.select(F.lit(0).alias("id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull()))
    found = rows.mapInArrow(_count, "gram int, sentence string, n long").groupBy("gram", "sentence").agg(F.sum("n").alias("n"))
    counts = found.mapInArrow(_once, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    # one row per hash, seen or not: 2^(BITS+1) rows come to the driver at any size of the corpus
    every = docs.sparkSession.range(2 << BITS).select(F.col("id").cast("int").alias("gram"))
    got = every.join(counts, "gram", "left").select("gram", F.coalesce("n", F.lit(0)).alias("n")).toArrow()
    out = np.zeros(2 << BITS, np.float64)
    out[got["gram"].to_numpy()] = got["n"].to_numpy()
    return out


@dataclass
class Model:
    """Log-likelihood ratios by gram hash, one row per kind of residue, and those of fields by shape."""

    kinds: list[str]
    ratios: np.ndarray
    shapes: np.ndarray


def log_prose(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of prose; a corpus without text makes all grams equally improbable."""
    total = counts.sum()
    return np.maximum(np.log((counts + 0.5) / (total + 0.5 * len(counts))), FLOOR) if total else np.full(len(counts), FLOOR)


def log_seeds(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of seeds; a form that they repeat with many names weighs less than in proportion."""
    n = np.sqrt(counts.astype(np.float64))
    return np.log((n + 1e-3) / (n.sum() + 1e-3 * len(n)))


def fit(prose: np.ndarray) -> Model:
    """Ratios of the seed models to prose, from its counts."""
    size = 1 << BITS
    texts, shapes = log_prose(prose[:size]), log_prose(prose[size:])
    kinds, rows = [], []
    for kind, text in seeds().items():
        n = np.bincount(grams(codes(plain(text))), minlength=size)
        kinds.append(kind)
        rows.append(np.clip(log_seeds(n) - texts, LEAST, MOST[kind]))
    n = np.bincount(np.concatenate([grams(codes(g)) for g in shape_grams()]), minlength=size)
    whole = lambda x: np.round(np.array(x) * UNIT).astype(np.int32)
    return Model(kinds, whole(rows), whole(np.clip(log_seeds(n) - shapes, 2 * LEAST, SHAPE_MOST)))


def windows(text: str, model: Model) -> list[tuple[int, int, str, float]]:
    """Residue in one plain text: (begin, end, kind, ratio) of joined windows, for looking into a single text."""
    best, cover, kind = _judge([text], model)
    if best[0] <= 0:
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], cover[: len(text)].astype(np.int8), [0]])))
    return [(int(a), int(b), model.kinds[kind[0]], float(best[0])) for a, b in zip(edge[::2], edge[1::2])]


def _judge(held: list[str], model: Model, strictness: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the most by which a window's ratio exceeds ``strictness`` times its threshold (0 if none) and its kind; for each character whether such a window covers it."""
    c = codes(hide(_GAP.join([*held, ""])))
    ends = np.cumsum([len(t) + len(_GAP) for t in held])
    text_ends = ends - len(_GAP)
    g = grams(c)
    edge = np.zeros(len(c) + 1, np.int32)
    best, kind = np.zeros(len(held), np.int32), np.zeros(len(held), np.int64)
    quoted = c == ord(_HIDDEN)

    def sweep(r: np.ndarray, at: np.ndarray | None, k: int, lengths: tuple[int, ...], least: float) -> None:
        """Windows over the ratios ``r`` of grams that begin at the characters ``at``.

        A longer window is some shortest ones side by side, one of which has at least its share of the
        ratio, so only those around such a shortest window are looked at.
        """
        total = np.zeros(len(r) + 1, np.int32)
        np.cumsum(r, out=total[1:])
        least, short = int(least * UNIT), lengths[0]
        likely = np.flatnonzero(total[short:] - total[:-short] > least // (lengths[-1] // short))
        for w in lengths if len(likely) else ():
            start = likely if w == short else np.unique(np.add.outer(likely, -np.arange(0, w, short)))
            start = start[(start >= 0) & (start <= len(r) - w)]
            over = total[start + w] - total[start] - least
            hit, over = start[over > 0], over[over > 0]
            begin = hit if at is None else at[hit]
            row = np.searchsorted(ends, begin, side="right")
            inside = begin < text_ends[row]
            hit, over, row = hit[inside], over[inside], row[inside]
            if not len(hit):
                continue
            top = np.zeros(len(held), np.int32)
            np.maximum.at(top, row, over)
            better = top > best
            best[better], kind[better] = top[better], k
            # trimmed to where its evidence begins and ends
            good = np.flatnonzero(r > 0)
            first = good[np.searchsorted(good, hit)]
            last = good[np.searchsorted(good, hit + w) - 1]
            np.add.at(edge, first if at is None else at[first], 1)
            np.add.at(edge, np.minimum(last + GRAM if at is None else at[np.minimum(last + GRAM - 1, len(at) - 1)] + 1, text_ends[row]), -1)

    neutral = np.add.outer(text_ends, np.arange(1 - GRAM, len(_GAP))).ravel()
    neutral = neutral[(neutral >= 0) & (neutral < len(g))]
    barred = np.flatnonzero(quoted[: len(g)])
    for k, ratios in enumerate(model.ratios):
        r = ratios[g]
        r[neutral] = 0
        r[barred] = 2 * LEAST * UNIT
        sweep(r, None, k, WINDOWS, strictness * THRESHOLDS[model.kinds[k]])
    s, at = shape(c)
    r = model.shapes[grams(s)]
    for flag, x in ((s == ord("\n"), 0), (quoted[at], -1000 * UNIT)):
        r[np.logical_or.reduce([flag[i : i + len(r)] for i in range(GRAM)])] = x
    sweep(r, at, model.kinds.index("field"), SHAPE_WINDOWS, strictness * SHAPE_THRESHOLD)
    return best / np.float32(UNIT), np.cumsum(edge) > 0, kind


def _scorer(model, strictness: float):
    """A function for mapInArrow over (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for b in slices(batches, 4_000_000):
            texts = [plain(t) if t else "" for t in b.column(1).to_pylist()]
            chars, best, kinds = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.float32), np.zeros(len(texts), np.int64)
            # quotations of a text that is cut into parts are looked for before that
            for rows, held in _pieces([hide(t) if len(t) > _CHUNK else t for t in texts], _OVERLAP):
                top, cover, kind = _judge(held, m, strictness)
                at = 0
                for i, t, x, k in zip(rows, held, top.tolist(), kind.tolist()):
                    if x > 0:
                        chars[i] += int(cover[at : at + len(t)].sum())
                        if x > best[i]:
                            best[i], kinds[i] = x, k
                    at += len(t) + len(_GAP)
            hit = np.flatnonzero(best > 0)
            size = np.array([len(t) for t in texts], np.float64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(hit)), pa.array([m.kinds[k] for k in kinds[hit]], pa.string()), pa.array(np.minimum(1.0, chars[hit] / size[hit])), pa.array(best[hit].astype(np.float64))],
                ["id", "kind", "coverage", "excess"],
            )

    return run


def residue(docs: DataFrame, id: str = "doc_id", text: str = "text", least_coverage: float = 0.0, strictness: float = 1.0) -> DataFrame:
    """(id, kind, coverage, excess) of each row with residue that covers more than ``least_coverage`` of its text.

    kind is that of the strongest window, excess by how much it passes its threshold; ``strictness``
    multiplies the thresholds. Null, empty and
    blank texts have none; repeated rows are judged each; other columns are ignored. The corpus is read
    twice and not shuffled but for each task's distinct suspect sentences and 2^(BITS+1) counts; the model
    has that size at any scale.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(prose_counts(docs, text)))
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    found = spread(rows).mapInArrow(_scorer(model, strictness), f"id {kind}, kind string, coverage double, excess double")
    return found.where(F.col("coverage") > least_coverage).withColumnRenamed("id", id) if id != "id" else found.where(F.col("coverage") > least_coverage)
