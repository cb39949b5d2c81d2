"""Language ID by cross-parsing entropy.

Labelled text of each language is compiled into a suffix automaton. A text is cut greedily
into phrases, each the longest match that the automaton contains (a character that it lacks is
a phrase of its own). The language with the fewest phrases per character wins.

The automata are fitted on a bounded sample: up to ``CHARS`` characters in all, shared evenly
by the languages, ``PIECE`` characters from the middle of each sampled text, texts taken in
the order of a hash. Every labelled language and every character of the sample takes part.
Everything else covers whole texts: they are parsed in blocks of
``STEP`` characters, all blocks of a batch and all languages at once.

Edge cases: null texts and texts without a letter are ``und`` with score 0; with no learnt
language every text is ``und``; ties go to the alphabetically first language; a null doc_id
counts as learning text only if the caller's filter keeps it; repeated rows are predicted
alike; an empty table gives an empty result. Rows without text or lang teach nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of the sample: characters of all languages, of one language, of one text.
CHARS = 400_000
CHARS_PER_LANG = 25_000
PIECE = 400
#: Characters of a block that is parsed from a fresh phrase.
STEP = 512
#: Children from which a state's transitions get a range of their own; slots tried at a time.
WIDE, TRIED = 32, 256
#: Characters of a text that are held as integers at a time; a multiple of STEP.
SLICE = 1 << 20


def sample(labelled: DataFrame) -> dict[str, str]:
    """Learning text per language from (text, lang), within the bounds above.

    Counts of different texts per language set a hash threshold that is expected to keep twice
    the texts needed, so only a bounded number of pieces leaves the executors.
    """
    rows = labelled.where("text is not null and lang is not null and length(text) > 0")
    order = F.xxhash64("text", F.lit(11))
    counts = rows.select("lang", order).distinct().groupBy("lang").count().collect()
    if not counts:
        return {}
    each = max(1, min(CHARS_PER_LANG, CHARS // len(counts)))
    want = max(1, each // (PIECE // 4))
    parts = 1 << 30
    share = {r["lang"]: min(parts, 2 * want * parts // r["count"] + 1) for r in counts}
    limit = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    piece = F.substring("text", F.greatest(F.lit(1), F.floor((F.length("text") - PIECE) / 2).cast("int") + 1), F.lit(PIECE))
    kept = rows.where(F.pmod(order, F.lit(parts)) < F.element_at(limit, F.col("lang")))
    # Copies have one hash: they are one text of the sample, however many rows they fill.
    kept = kept.select("lang", order.alias("h"), piece.alias("piece")).distinct()
    texts: dict[str, list[str]] = {}
    for r in sorted(kept.collect()):
        texts.setdefault(r["lang"], []).append(r["piece"])
    return {lang: "\n".join(x)[:each] for lang, x in sorted(texts.items())}


class _Automaton:
    """Transitions of the suffix automaton of a sequence of small integers."""

    def __init__(self, seq: list[int]):
        nexts, link, length, last = [{}], [-1], [0], 0
        for c in seq:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.nexts = nexts


class _Transitions:
    """The transitions of all automata in a double array.

    State s goes by character c to ``target[base[s] + c]`` if ``check[base[s] + c]`` is s: as many
    slots as transitions, about, however many characters there are.
    """

    def __init__(self, nexts: list[dict[int, int]], chars: int):
        self.base = np.zeros(len(nexts), dtype=np.int32)
        self._used = np.zeros(1 << 16, dtype=bool)
        first = end = low = chars + 1
        placed: list[tuple[int, np.ndarray]] = []
        for s in sorted((s for s, x in enumerate(nexts) if len(x) > 1), key=lambda s: -len(nexts[s])):
            cs = np.fromiter(nexts[s], np.int64)
            self._room(end + 2 * chars + TRIED)
            at = end - int(cs.min())
            if len(cs) <= WIDE:
                free = low + np.flatnonzero(~self._used[low : low + TRIED])
                bases = free - cs[0]
                fits = np.flatnonzero(~self._used[bases[:, None] + cs[None, :]].any(axis=1))
                if len(fits):
                    at = int(bases[fits[0]])
                if len(free) < TRIED // 4 or not len(fits):
                    low = min(low + TRIED, end)
            self._used[at + cs] = True
            end = max(end, at + int(cs.max()) + 1)
            self.base[s] = at
            placed.append((s, cs))
        single = np.array([s for s, x in enumerate(nexts) if len(x) == 1], dtype=np.int64)
        self._room(end + len(single))
        slots = first + np.flatnonzero(~self._used[first : end + len(single)])[: len(single)]
        only = np.array([next(iter(nexts[s])) for s in single], dtype=np.int64)
        self.base[single] = slots - only
        size = int(max(end, slots.max(initial=0) + 1)) + chars + 1
        self.check = np.full(size, -1, dtype=np.int32)
        self.target = np.zeros(size, dtype=np.int32)
        self.check[slots] = single
        self.target[slots] = [next(iter(nexts[s].values())) for s in single]
        for s, cs in placed:
            self.check[self.base[s] + cs] = s
            self.target[self.base[s] + cs] = list(nexts[s].values())
        del self._used

    def _room(self, size: int) -> None:
        if size > len(self._used):
            self._used = np.concatenate([self._used, np.zeros(max(size, len(self._used)), dtype=bool)])


class Parser:
    """Counts cross-parsing phrases of texts against the automaton of each language.

    A character that a state does not lead on by ends a phrase; the next one starts with it, or,
    where the language lacks it, after it.
    """

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        chars = sorted(set("".join(texts.values()).lower()))
        # Class 0 is any other character, which leads nowhere.
        classes = np.zeros(0x110000, dtype=np.int32)
        classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        for code in range(0x110000):
            low = chr(code).lower()
            if len(low) == 1 and ord(low) != code:
                classes[code] = classes[ord(low)]
        self.classes = classes
        nexts, roots = [], []
        for lang in self.langs:
            base = len(nexts)
            roots.append(base)
            seq = classes[self._codes(texts[lang])].tolist()
            nexts += [{c: base + t for c, t in x.items() if c} for x in _Automaton(seq).nexts]
        self.roots = np.array(roots, dtype=np.int32)
        self.table = _Transitions(nexts, len(chars) + 1)

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text (rows) under each language (columns)."""
        k = len(self.langs)
        out = np.zeros((len(texts), k), dtype=np.int64)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        blocks = -(-sizes // STEP)
        owner = np.repeat(np.arange(len(texts)), blocks)
        span = max(16, (1 << 15) // k)
        flat = np.concatenate([self.classes[self._codes("".join(texts))], np.zeros(STEP, np.int32)])
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        first = np.concatenate([[0], np.cumsum(blocks)])[:-1]
        begin = starts[owner] + STEP * (np.arange(len(owner)) - first[owner])
        long = np.minimum(begin + STEP, (starts + sizes)[owner]) - begin
        # Long blocks lead, so that those still going are a prefix.
        order = np.argsort(-long, kind="stable")
        for at in range(0, len(order), span):
            some = order[at : at + span]
            chars = np.ascontiguousarray(flat[begin[some][:, None] + np.arange(STEP)[None, :]].T)
            going = np.searchsorted(-long[some], -np.arange(STEP), side="left")
            np.add.at(out, owner[some], self._parse(chars, going))
        return out

    def _parse(self, chars: np.ndarray, going: np.ndarray) -> np.ndarray:
        """Phrases of blocks of characters: chars by (step, block); at step j ``going[j]`` blocks go on."""
        base, check, target, k = self.table.base, self.table.check, self.table.target, len(self.langs)
        roots = np.tile(self.roots, chars.shape[1])
        state, count = roots.copy(), np.zeros(len(roots), dtype=np.int32)
        for j, n in enumerate(going.tolist()):
            if not n:
                break
            old = state[: n * k]
            index = base.take(old)
            index.reshape(n, k)[:] += chars[j, :n, None]
            miss = np.flatnonzero(check.take(index) != old)
            left, root = old[miss], roots[miss]
            target.take(index, out=old, mode="clip")  # indices are within bounds
            again = base[root] + chars[j, miss // k]
            starts = check[again] == root
            old[miss] = np.where(starts, target[again], root)
            count[miss] += 1 + (~starts & (left != root))
        return (count + (state != roots)).reshape(-1, k)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and phrases per character of the winner, for each text."""
        lang = ["und"] * len(texts)
        score, rate = np.zeros(len(texts)), np.ones(len(texts))
        mine = [i for i, t in enumerate(texts) if t and self.langs and _has_letter(t)]
        if not mine:
            return lang, score, rate
        sizes = np.array([len(texts[i]) for i in mine])
        phrases = np.zeros((len(mine), len(self.langs)), dtype=np.int64)
        part, owner, held = [], [], 0
        for j, i in enumerate(mine):
            for at in range(0, len(texts[i]), SLICE):
                part.append(texts[i][at : at + SLICE])
                owner.append(j)
                held += len(part[-1])
                if held >= SLICE:
                    np.add.at(phrases, owner, self.phrases(part))
                    part, owner, held = [], [], 0
        if part:
            np.add.at(phrases, owner, self.phrases(part))
        rates = phrases / sizes[:, None]
        best = rates.argmin(axis=1)
        lead = rates[np.arange(len(mine)), best]
        others = rates.copy()
        others[np.arange(len(mine)), best] = np.inf
        second = others.min(axis=1) if len(self.langs) > 1 else np.full(len(mine), 1.0)
        sure = np.clip((second - lead) / np.maximum(second, 1e-12), 0, 1)
        for j, i in enumerate(mine):
            lang[i], score[i], rate[i] = self.langs[best[j]], sure[j], min(1.0, lead[j])
        return lang, score, rate


def _has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def predict(
    docs: DataFrame,
    texts: dict[str, str],
    keep: tuple[str, ...] = (),
    names: tuple[str, str, str] = ("lang_pred", "score", "rate"),
) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score (0 to 1) and rate.

    score is the winner's lead in phrases over the second; rate its phrases per character.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(texts)  # at most CHARS characters
    mark = hash(tuple(sorted(texts.items())))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        parser = common.worker_state("langid", mark, lambda: Parser(shared.value))
        lang, score, rate = parser.predict(batch.column(0).to_pylist())
        new = [pa.array(lang, pa.string()), pa.array(score), pa.array(rate)]
        return pa.record_batch(batch.columns[1:] + new, names=[*batch.schema.names[1:], *names])

    rows = docs.select(F.col("text").alias("__text"), *keep)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] if keep else []
    schema = ", ".join([*kept, *(f"`{n}` {t}" for n, t in zip(names, ("string", "double", "double"), strict=True))])
    return common.map_batches(rows, each, schema)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows that no automaton may learn from; a null id has none, and is not held out."""
    ident = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(ident.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame) -> dict[str, str]:
    return sample(docs.where(~held_out()).select("text", "lang"))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rate) for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    table = rows.withColumn("held_out", held_out())
    return predict(table, learn(rows), ("doc_id", "held_out"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language cannot be told (``und``) go.

    Those are null and empty texts and texts without a letter. Where no language could be learnt,
    texts with a letter stay all the same. Rows that repeat are judged alike.
    """
    texts = learn(docs)
    if not texts:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = predict(docs, texts, tuple(docs.columns), ("__lang", "__score", "__rate"))
    return found.where("__lang <> 'und'").select(*docs.columns)
