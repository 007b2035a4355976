"""Toxicity scores from a lexicon trie walked by Levenshtein automata, with context windows around each hit.

*Lexicon.* Whole words and stems. A short list of common insults is given; the rest is learned from a bounded sample of
labelled documents: words, and beginnings that several words share, which stand in toxic documents after many
different words and practically nowhere else. Counting different neighbours keeps the words of one text that was
copied often from passing for insults.

*Misspellings.* The trie of all whole words of four letters or more and all stems of five or more is intersected with the
automata that accept one edit (insertion, deletion, substitution or swap of neighbours); a stem takes its edit before its
free tail. Letters are code points, so a lost accent is one edit. The product is made deterministic and kept as one table
of (state, letter class), so all words of a chunk walk it at once in numpy, and nearly all leave it after a few letters.
Terms whose misspellings stand in clean sample documents take no edit: the product is made anew without theirs.

*Windows.* Each hit looks at ``WINDOW`` words on both sides: quotation marks or words of reporting mark it as quoted and
cut its weight, words of address and other hits raise it. A logistic model on a document's window sums gives the score.

Defined results: null, empty and wordless texts have no hit and get the score of the base terms alone; labels other than
0 and 1 are ignored; without usable labels of both kinds the given list and fixed weights apply; repeated rows get equal
scores; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexer, rows

FIT_ROWS = 6_000
WINDOW = 8
LEAST_SUPPORT = 8
#: How much denser in toxic than in clean documents a learned term stands; the windows judge what clean documents quote.
RATIO = 3
#: Ratio from which on a term counts in full.
FULL = 32
#: Letters from which on whole words and stems may be misspelled.
FUZZY_LETTERS = 4
FUZZY_STEM = 5
#: A term takes an edit if at most one misspelling of it stands in so many clean documents.
CLEAN_TEXTS = 2000

# Common insults in four languages.
INSULTS = (
    "idiot idiots moron morons stupid worthless pathetic disgusting trash scum loser losers clown imbecile retard bastard bitch whore asshole fuck fucking fucker cunt "
    "arschloch hurensohn wichser fotze schlampe idiota imbécil estúpido estúpida puta cabrón gilipollas connard connasse salope enculé abruti pouffiasse"
).split()
# Words of reporting and of address.
REPORTING = "said says wrote writes called quote quoted dijo escribió dit écrit sagte schrieb zitat".split()
ADDRESS = "you your you're du dich dein tu te ton toi vous tú eres usted".split()

LETTERS = lexer.byte_mask(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") | (np.arange(256) >= 128)
INNER = LETTERS | lexer.byte_mask(b"@$*")
QUOTES = lexer.byte_mask(b"\"")
#: Last bytes of quotation marks written in three and two bytes.
_LONG_QUOTES = ["“", "”", "„", "«", "»"]


def fold(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


_WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+(?:[@$*]+[a-z0-9\x80-\U0010ffff]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(fold(text))


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and for each byte position how many of them start before it."""
    first = (data & 0xC0) != 0x80
    before = np.append(0, np.cumsum(first))
    at = np.flatnonzero(first)
    if len(at) == len(data):
        return data.astype(np.int32), before
    whole = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
    points = whole[at]
    for least, keep, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        long = np.flatnonzero((data[at] >= least) & (data[at] < (0xE0, 0xF0, 0x100)[more - 1]))
        value = whole[at[long]] & keep
        for i in range(1, more + 1):
            value = (value << 6) | (whole[at[long] + i] & 0x3F)
        points[long] = value
    return points, before


class Automaton:
    """The trie of ``words`` and ``stems`` times one-edit automata, as a table of (state, letter class).

    ``exact[state]`` and ``fuzzy[state]`` tell the term that a word ending in the state is, or -1; a stem's state keeps the word.
    ``close[state]`` are all terms that such a word is one edit away from. ``plain`` terms take no edit.
    """

    def __init__(self, words: list[str], stems: list[str], plain: frozenset[str] = frozenset()) -> None:
        self.terms = [*words, *stems]
        letters = sorted({ord(c) for term in self.terms for c in term})
        #: Classes of ASCII, capitals as small letters; others are looked up.
        self.letters = np.array(letters, dtype=np.int32)
        self.ascii = np.zeros(128, dtype=np.int32)
        self.ascii[[c for c in letters if c < 128]] = [i + 1 for i, c in enumerate(letters) if c < 128]
        self.ascii = self.ascii[lexer.FOLD[:128]]
        # A trie node lists its children, the whole word that ends there and the stem that ends there.
        child: list[dict[int, int]] = [{}]
        word_at: dict[int, int] = {}
        stem_at: dict[int, int] = {}
        for i, term in enumerate(self.terms):
            at = 0
            for b in map(ord, term):
                if b not in child[at]:
                    child[at][b] = len(child)
                    child.append({})
                at = child[at][b]
            (word_at if i < len(words) else stem_at).setdefault(at, i)
        fuzzy_ok = {i for i, w in enumerate(self.terms) if w not in plain and len(w) >= (FUZZY_LETTERS if i < len(words) else FUZZY_STEM)}
        # Nodes that lead to a term that may be misspelled.
        leads = [False] * len(child)
        for node in range(len(child) - 1, -1, -1):
            leads[node] = word_at.get(node) in fuzzy_ok or stem_at.get(node) in fuzzy_ok or any(leads[c] for c in child[node].values())

        def step(state: frozenset, b: int) -> frozenset:
            out = set()
            for node, edits, owed in state:
                if owed is not None:
                    # A swap is half done: the letter that was skipped must come now.
                    if b == owed:
                        out.add((node, 1, None))
                    continue
                if node in stem_at and (edits == 0 or stem_at[node] in fuzzy_ok):
                    out.add((node, edits, None))
                nxt = child[node].get(b)
                if nxt is not None:
                    out.add((nxt, edits, None))
                if edits == 0 and leads[node]:
                    out.add((node, 1, None))
                    for c, kid in child[node].items():
                        if leads[kid]:
                            out.add((kid, 1, None))
                            after = child[kid].get(b)
                            if after is not None:
                                out.add((after, 1, None))
                                if c != b:
                                    out.add((after, 1, c))
            # Whatever an exact path reaches needs no edited copy, and after an exact stem nothing does.
            exact = {n for n, e, o in out if e == 0}
            if exact & stem_at.keys():
                return frozenset(x for x in out if x[1] == 0)
            return frozenset(x for x in out if not (x[1] == 1 and x[2] is None and x[0] in exact))

        start = frozenset({(0, 0, None)})
        number, queue, table = {start: 1, frozenset(): 0}, [start], {0: [0] * (len(letters) + 1)}
        while queue:
            state = queue.pop()
            row = []
            for b in (-1, *letters):
                new = step(state, b)
                if new not in number:
                    number[new] = len(number)
                    queue.append(new)
                row.append(number[new])
            table[number[state]] = row
        self.table = np.array([table[i] for i in range(len(number))], dtype=np.int32)
        self.exact, self.fuzzy, self.close = np.full(len(number), -1, np.int32), np.full(len(number), -1, np.int32), [()] * len(number)
        for state, i in number.items():
            near = set()
            for node, edits, owed in state:
                if owed is not None:
                    continue
                if edits == 0 and node in stem_at:
                    self.exact[i] = max(self.exact[i], stem_at[node])
                # A last letter may be missing.
                for end in (node,) if edits == 1 else (*child[node].values(),):
                    near |= {at[end] for at in (word_at, stem_at) if at.get(end) in fuzzy_ok}
            for node in {n for n, e, o in state if e == 0 and o is None and n in word_at}:
                self.exact[i] = word_at[node]
            if near:
                self.fuzzy[i], self.close[i] = min(near), tuple(sorted(near))

    def states(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The state in which each word ends, 0 for none."""
        points, before = code_points(data)
        classes = self.ascii[np.minimum(points, 127)]
        wide = np.flatnonzero(points > 127)
        if len(wide) and len(self.letters):
            at = np.minimum(np.searchsorted(self.letters, points[wide]), len(self.letters) - 1)
            classes[wide] = np.where(self.letters[at] == points[wide], at + 1, 0)
        at, ends = before[starts], before[ends]
        final = np.zeros(len(starts), dtype=np.int32)
        alive, state = np.arange(len(starts)), np.ones(len(starts), dtype=np.int32)
        while len(alive):
            state = self.table[state, classes[at]]
            going = state > 0
            alive, at, state = alive[going], at[going] + 1, state[going]
            done = at == ends[alive]
            final[alive[done]] = state[done]
            alive, at, state = alive[~done], at[~done], state[~done]
        return final

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exact term, term with an edit) of each word, -1 for none."""
        final = self.states(data, starts, ends)
        exact = self.exact[final]
        return exact, np.where(exact >= 0, -1, self.fuzzy[final])


def trimmed_words(chunk: lexer.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of letters and digits with @, $ or * allowed inside: starts, ends, document."""
    if not len(chunk.data):
        return (np.zeros(0, np.int64),) * 3
    starts, ends, bounds = chunk.ranges(INNER)
    doc = np.repeat(np.arange(len(chunk)), np.diff(bounds))
    letters = np.flatnonzero(LETTERS[chunk.data])
    first = np.searchsorted(letters, starts)
    last = np.searchsorted(letters, ends)
    some = last > first
    return letters[first[some]], letters[last[some] - 1] + 1, doc[some]


def _keys_of(words: list[str]) -> np.ndarray:
    import pyarrow as pa

    return np.sort(np.concatenate([lexer.words(c).keys for c in lexer.chunks(pa.array(words))]))


@dataclass
class Detector:
    automaton: Automaton
    #: How far each term counts, up to 1.
    power: np.ndarray
    weights: np.ndarray

    def features(self, chunk: lexer.Chunk) -> np.ndarray:
        """Per document: sums over its hits of windowed weights; columns exact, with an edit, quoted, addressed, crowded, share of words."""
        starts, ends, doc = trimmed_words(chunk)
        n = len(chunk)
        exact, fuzzy = self.automaton.run(chunk.data, starts, ends)
        hit = np.flatnonzero((exact >= 0) | (fuzzy >= 0))
        out = np.zeros((n, 6))
        if not len(hit):
            return out
        doc_bounds = np.searchsorted(doc, np.arange(n + 1))
        low = np.maximum(hit - WINDOW, doc_bounds[doc[hit]])
        high = np.minimum(hit + WINDOW + 1, doc_bounds[doc[hit] + 1])
        quoted = self._quoted(chunk, starts, ends, hit, low, high)
        keys = self._near_keys(chunk, starts, ends, low, high)
        reported = keys(_keys_of(REPORTING))
        addressed = keys(_keys_of(ADDRESS)) > 0
        quoted |= reported > 0
        total = np.append(0, np.cumsum(np.isin(np.arange(len(starts)), hit, assume_unique=True)))
        crowd = total[high] - total[low] - 1
        plain = np.where(quoted, 0.25, 1.0) * self.power[np.where(exact[hit] >= 0, exact[hit], fuzzy[hit])]
        own = doc[hit]
        sums = lambda x: np.bincount(own, x, minlength=n)
        is_exact = exact[hit] >= 0
        exact_sum, edit_sum = sums(plain * is_exact), sums(plain * ~is_exact)
        share = (exact_sum + edit_sum) / np.maximum(np.diff(doc_bounds), 1)
        out[:] = np.column_stack([np.log1p(exact_sum), np.log1p(edit_sum), np.log1p(sums(quoted * 1.0)), np.log1p(sums(addressed * plain)), np.log1p(sums(crowd * plain)), np.minimum(10 * share, 1)])
        return out

    @staticmethod
    def _quoted(chunk, starts, ends, hit, low, high) -> np.ndarray:
        """Whether an opening mark stands before the hit and a closing one after it, inside the window."""
        mark = QUOTES[chunk.data].copy()
        for text in _LONG_QUOTES:
            raw = text.encode()
            ok = np.ones(max(0, len(chunk.data) - len(raw) + 1), dtype=bool)
            for i, b in enumerate(raw):
                ok &= chunk.data[i : i + len(ok)] == b
            mark[np.flatnonzero(ok)] = True
        total = np.append(0, np.cumsum(mark))
        before = total[starts[hit]] - total[starts[low]]
        after = total[ends[high - 1]] - total[ends[hit]]
        # Marks directly at the window's edge belong to it.
        before += mark[np.maximum(starts[low] - 1, 0)] & (starts[low] > 0)
        after += mark[np.minimum(ends[high - 1], len(mark) - 1)] & (ends[high - 1] < len(mark))
        return (before % 2 == 1) & (after > 0)

    @staticmethod
    def _near_keys(chunk, starts, ends, low, high):
        """A function that counts in each window the words with one of the given keys."""
        count = high - low
        at = np.repeat(low - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(int(count.sum()))
        keys = chunk.keys_of(starts[at], ends[at], fold=True)
        bounds = np.append(0, np.cumsum(count))
        return lambda wanted: lexer.sums(np.isin(keys, wanted).astype(np.int64), bounds)

    def scores(self, chunk: lexer.Chunk) -> np.ndarray:
        margin = self.features(chunk) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def learn_terms(toxic: list[str], clean: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Whole words and stems that mark toxic texts, and how far each counts: less, the more clean texts have it."""
    support: Counter = Counter()
    neighbours: dict[str, set] = defaultdict(set)
    ways: dict[str, set] = defaultdict(set)
    for text in toxic:
        own: dict[str, set] = defaultdict(set)
        before = ""
        for word in words_of(text):
            if len(word) >= 3:
                own[f"{word}$"].add(before)
                for n in range(4, min(len(word), 7) + 1):
                    own[word[:n]].add(before)
                    ways[word[:n]].add(word[n : n + 1])
            before = word
        # A text supports a term once, and only if it has the term after a word that no earlier text had.
        for term, words in own.items():
            if not words <= neighbours[term]:
                support[term] += 1
                neighbours[term] |= words
    seen: Counter = Counter()
    for text in clean:
        found = set(words_of(text))
        seen.update({w[:n] for w in found if len(w) > 3 for n in range(4, min(len(w), 7) + 1)} | {f"{w}$" for w in found})
    even = len(toxic) / max(len(clean), 1)
    # Chance alone gives a term this support with a probability of at most exp(-evidence); so many terms are tried.
    tried = np.log(1 + sum(n >= LEAST_SUPPORT for n in support.values()))

    def marks(term: str) -> bool:
        n, expected = support[term] + 0.5, seen[term] * even + 0.5
        return support[term] >= LEAST_SUPPORT and n >= RATIO * expected and n * np.log(n / expected) - (n - expected) >= tried

    good = {s for s in support if not s.endswith("$") and len(ways[s]) >= 4 and marks(s)}
    # A stem that nearly all its words carry on with one letter is only a part of the longer stem.
    good = {s for s in good if not any(s + c in support and support[s + c] >= 0.9 * support[s] for c in ways[s] if c)}
    kept = sorted(s for s in good if not any(s[:n] in good for n in range(4, len(s))))
    words = sorted(t[:-1] for t in support if t.endswith("$") and marks(t) and not any(t.startswith(s) for s in kept))
    power = lambda term: min(1.0, float(np.log((support[term] + 0.5) / (seen[term] * even + 0.5)) / np.log(FULL)))
    return {w: power(f"{w}$") for w in words}, {s: power(s) for s in kept}


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Newton steps for logistic regression, held near ``prior``."""
    x = np.column_stack([np.ones(len(x)), x])
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + strength * (w - prior)
        bend = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + strength * np.eye(len(w))
        change = np.linalg.solve(bend, slope)
        w = w - np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-6:
            break
    return w


#: Weights before any label is seen: a plain hit makes a text toxic, quoted ones alone do not.
PRIOR = np.array([-3.0, 5.0, 4.5, 0.0, 0.5, 0.5, 1.0])


def fit(sample: list[tuple[str, int]]) -> Detector:
    """A detector from (text, label) rows."""
    import pyarrow as pa

    toxic, clean = [t or "" for t, y in sample if y == 1], [t or "" for t, y in sample if y == 0]
    words, stems = learn_terms(toxic, clean) if toxic and clean else ({}, {})
    power = {**stems, **words, **dict.fromkeys(INSULTS, 1.0)}
    words, stems = sorted(words.keys() | set(INSULTS)), sorted(stems)
    automaton = Automaton(words, stems)
    ends = np.zeros(len(automaton.close), dtype=np.int64)
    for chunk in lexer.chunks(pa.array(clean, pa.string())):
        ends += np.bincount(automaton.states(chunk.data, *trimmed_words(chunk)[:2]), minlength=len(ends))
    wrong = Counter()
    for state in np.flatnonzero((ends > 0) & (automaton.exact < 0)):
        wrong.update(dict.fromkeys(automaton.close[state], int(ends[state])))
    plain = frozenset(automaton.terms[i] for i, n in wrong.items() if n * CLEAN_TEXTS > len(clean))
    model = Detector(Automaton(words, stems, plain), np.array([power[t] for t in (*words, *stems)]), PRIOR)
    if toxic and clean:
        x = np.concatenate([model.features(c) for part in (toxic, clean) for c in lexer.chunks(pa.array(part, pa.string()))])
        y = np.concatenate([np.ones(len(toxic)), np.zeros(len(clean))])
        model.weights = _logistic(x, y, PRIOR)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held: int = 2, fit_rows: int = FIT_ROWS) -> Detector:
    """A detector fitted to at most ``fit_rows`` labelled documents outside the held-out fold."""
    sample = rows.labelled_sample(docs, labels, label, id_col, text_col, folds, held, fit_rows).collect()
    model = fit(sorted((t or "", y) for t, y in sample))
    share = sum(y for _, y in sample) / max(len(sample), 1)
    if 0 < share < 1:
        p = rows.base_rate(labels, label, folds, held)
        model.weights = model.weights.copy()
        model.weights[0] += np.log(p / (1 - p)) - np.log(share / (1 - share))
    return model


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted``."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    marked = docs.select(F.col(id_col), (rows.fold_of(id_col, 4) == 2).alias("held_out"), F.col(text_col))
    out = rows.append(marked, text_col, lambda chunk: {"score": model.scores(chunk)}, {"score": "double"})
    return out.select(id_col, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
