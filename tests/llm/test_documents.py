"""Operators over documents: brute force, defined results of awkward rows, empty tables."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from frames import awkward, empty, fold, labels, spaced

from threadloom.llm import hostrules, jaccard, lexer, mixing, packing, ppm, quality, toxicity
from threadloom.llm.queries import vocabulary


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def shingles(text):
    w = spaced(fold(text))
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([" ".join(w)] if w else [])


def test_words_lines_and_shingles_of_chunks(texts):
    column = pa.array([t for _, t in texts])
    for chunk in lexer.chunks(column):
        found, (starts, ends, doc) = lexer.words(chunk), lexer.lines(chunk)
        _, _, bounds = lexer.shingle_sets(chunk)
        for i in range(len(chunk)):
            text = texts[chunk.first + i][1] or ""
            own = slice(found.bounds[i], found.bounds[i + 1])
            assert [bytes(chunk.data[a:b]).decode() for a, b in zip(found.starts[own], found.ends[own])] == spaced(text)
            assert [bytes(chunk.data[a:b]).decode() for a, b in zip(starts[doc == i], ends[doc == i])] == text.split("\n")
            assert bounds[i + 1] - bounds[i] == len(shingles(text))


def test_jaccard_components_equal_brute_force(docs, texts):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_components(docs).collect())
    sets = [(i, shingles(t)) for i, t in texts if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, own in sets:
        for j, other in sets:
            if i < j and own and 100 * len(own & other) >= 80 * len(own | other):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == Counter((i, len(shingles(t)), find(i) if i is not None else None) for i, t in texts)


def test_every_text_of_a_repeated_id_is_linked_and_kept(spark):
    base = [f"w{i}" for i in range(60)]
    long, near = " ".join(base), " ".join([*base[:59], "changed"])
    rows = [(1, "some other text stands here alone", "a"), (1, long, "b"), (2, near, "c"), (3, "x y z", "d"), (3, "x y z", "d"), (None, near, "e"), (4, None, "f"), (4, "", "g"), (5, near, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.similar_components(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (None, None), (4, 4), (4, 4), (5, 1)], key=str)
    kept = sorted(((r.doc_id, r.text or "") for r in jaccard.one_of_each(docs).collect()), key=str)
    assert kept == sorted([(1, rows[0][1]), (1, long), (3, "x y z"), (4, ""), (None, near)], key=str)
    assert jaccard.one_of_each(docs).columns == docs.columns


def test_components_of_chains_stars_and_random_edges(spark):
    import random

    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    root = {x: x for e in edges for x in e}

    def find(i):
        return i if root[i] == i else find(root[i])

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {r.node: r.component for r in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}


def test_one_of_each_keeps_clean_documents_and_columns(docs):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert {1, 4, 5, 9} <= set(ids) and not {2, 3, 8} & set(ids) and ids.count(None) == 2 and ids.count(11) == 1


def test_sets_that_miss_their_head_link_inside_the_block():
    head = np.arange(100, dtype=np.uint64)
    far_a, far_b = np.arange(30, 130, dtype=np.uint64), np.arange(35, 135, dtype=np.uint64)
    rows = [(0, 2, far_a), (0, 3, far_b), (1, 2, far_a), (1, 3, far_b), (1, 4, head)]
    part = pa.table({"b": pa.array([1] * 5), "id": pa.array([r[1] for r in rows]), "n": pa.array([100] * 5), "role": pa.array([r[0] for r in rows]), "keys": pa.array([np.sort(r[2]).tobytes() for r in rows], pa.binary())})
    assert jaccard._join_block(part).to_pylist() == [{"u": 2, "v": 3}]


def test_host_rules_equal_brute_force(docs, texts):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in hostrules.document_verdicts(docs).collect())
    want = Counter()
    for i, t in texts:
        w, text = spaced(t), t or ""
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if spaced(x)]
        want[(i, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))] += 1
    assert got == want
    assert hostrules.keep_good(docs).columns == docs.columns


def test_host_verdicts_follow_shrunk_rates(spark):
    clean, some = " ".join(f"word{i}" for i in range(80)), " ".join(f"word{i}" + "#" * (i % 6 == 0) for i in range(80))
    rows = [(i, some if i % 2 else clean, None, "bad" if i < 60 else f"good{i % 5}", 0) for i in range(60)] + [(100 + i, clean, None, f"good{i % 5}", 0) for i in range(300)] + [(900, some, None, "good1", 0)]
    kept = {r.doc_id: r.kept for r in hostrules.document_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert kept[0] and not kept[1] and kept[900] and all(kept[100 + i] for i in range(300))


def test_quality_trees_learn_and_score_every_row(spark, docs, texts):
    marked = labels(spark, docs, lambda t: int(len(t) > 200))
    got = quality.scored(docs, marked).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) for r in got)
    assert quality.keep_good(docs, marked).columns == docs.columns
    none = quality.scored(docs, marked.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and len(none) == len(texts)


def test_boosted_trees_fit_a_rule_and_flatten():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    model = quality.fit(x[:1500], y[:1500])
    assert ((model.scores(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.97
    one = []
    for row in x[:20]:
        total = model.start
        for t in range(len(model.leaf)):
            node = 0
            while node < model.feature.shape[1]:
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.threshold[t, node])
            total += model.leaf[t, node - model.feature.shape[1]]
        one.append(total)
    assert np.allclose(model.margins(x[:20]), one)


def test_toxicity_automata_equal_edit_distance():
    def swaps_and_edits(a, b):
        if a == b:
            return 0
        near = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in set(b)} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in set(b)}
        near |= {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        return 1 if b in near else 2

    lexicon = ["stupid", "idiot", "trash", "scum", "cabrón", "bum"]
    words = ["stupid", "stuipd", "stpid", "stupidd", "sstupid", "tupid", "stupi", "stxpid", "stxpxd", "idoit", "idiots", "diot", "trahs", "rtash", "tras", "thrash", "scm", "scums", "scum", "sc*m", "cabron", "cabrön", "kabron", "cabróн", "CABRóN", "bam", "plain", "a", "é"]
    tails = ["lowei", "loweibung", "lowiebung", "loweeibung", "owei", "lwei-", "lxweiung", "lowe", "loweung", "loxxi", "lowóich", "wolei"]
    model = toxicity.Automaton(lexicon, ["lowei"])
    chunk = next(lexer.chunks(pa.array([" ".join([*words, *tails])])))
    exact, fuzzy = model.run(chunk.data, *toxicity.trimmed_words(chunk)[:2])
    assert len(exact) == len(words) + len(tails)
    for word, e, f in zip(words, exact, fuzzy):
        near = {t for t in lexicon if len(t) >= 4 and swaps_and_edits(t, word) == 1}
        own = word if word in lexicon else "cabrón" if word == "CABRóN" else None
        assert (model.terms[e] if e >= 0 else None) == own
        assert (f >= 0) == (bool(near) and e < 0), word
    for word, e, f in zip([t.strip("-") for t in tails], exact[len(words):], fuzzy[len(words):]):
        # A stem's misspelling is a beginning of the word, or all of it, one edit away from the stem.
        assert (e >= 0) == word.startswith("lowei")
        assert (f >= 0) == (e < 0 and any(swaps_and_edits("lowei", word[:n]) == 1 for n in range(1, len(word) + 1))), word
    plain = toxicity.Automaton(lexicon, ["lowei"], frozenset(["scum", "lowei"]))
    exact, fuzzy = plain.run(chunk.data, *toxicity.trimmed_words(chunk)[:2])
    assert not {"scum", "lowei"} & {plain.terms[i] for i in fuzzy if i >= 0} and {"stupid", "cabrón"} <= {plain.terms[i] for i in fuzzy if i >= 0}


def test_code_points_and_places_of_bytes():
    text = "aé中😀z"
    points, before = toxicity.code_points(np.frombuffer(text.encode(), np.uint8))
    assert points.tolist() == [ord(c) for c in text] and before.tolist() == [0, 1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 5]
    assert toxicity.code_points(np.zeros(0, np.uint8))[1].tolist() == [0]


def test_common_misspellings_are_found():
    model = toxicity.fit([])
    for word in "estupido cabron encule f*ck fuk scvm pu7a putaa stuupid idi0t moronn".split():
        assert float(model.scores(next(lexer.chunks(pa.array([f"you {word}"]))))[0]) >= 0.3, word


def test_toxicity_on_held_out_labels():
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"]).to_pandas()
    rows = docs.merge(pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pandas()[["doc_id", "toxic"]], on="doc_id").dropna(subset=["toxic"])
    rows["held"] = [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]
    seen, held = rows[~rows.held], rows[rows.held]
    model = toxicity.fit(sorted((t or "", int(y)) for t, y in zip(seen.text, seen.toxic)))
    score = np.concatenate([model.scores(c) for c in lexer.chunks(pa.array(held.text, pa.string()))])
    held = held.assign(hit=score >= 0.3)
    toxic = held[held.toxic == 1]
    assert toxic.hit.mean() >= 0.9 and (toxic.groupby("lang").hit.mean() > 0.8).all() and held[held.hit].toxic.mean() >= 0.9


def test_toxicity_separates_abuse_from_quotation_and_clean_text(spark, docs, texts):
    model = toxicity.fit([])
    score = lambda t: float(next(iter(model.scores(c) for c in lexer.chunks(pa.array([t]))))[0])
    plain, quoted, spelled, clean = score("you are a stupid idiot"), score('she said "stupid idiot" in the play'), score("you st*pid idoit"), score("a calm sentence about thrushes")
    assert plain > 0.8 and spelled > 0.8 and clean < 0.1 and quoted < plain
    got = toxicity.scored(docs, labels(spark, docs, lambda t: int("idiot" in t))).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in got)


def test_terms_of_one_copied_text_are_not_learned():
    copied = ["alpha bravo charlie delta echo foxtrot"] * 50
    abuse = [f"w{i} dreck v{i} and so on" for i in range(50)]
    words, stems = toxicity.learn_terms(copied + abuse, [f"w{i} calm v{i} and so on" for i in range(100)])
    assert words == {"dreck": 1.0} and not stems


def test_packing_is_whole_and_ids_are_the_tokenizers(docs, texts):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary())
    got = packing.pack(docs, vocabulary()).collect()
    want = Counter()
    for i, t in texts:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], np.uint32)
        head = (len(ids) - 1) % 1024 + 1
        for k, (a, b) in enumerate([(0, head)] + [(x, x + 1024) for x in range(head, len(ids), 1024)]):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 1024
    assert len(places) <= math.ceil(sum(r.length for r in got) / 1024) + 1
    rows = packing.sequences(docs.where("doc_id < 9"), vocabulary()).collect()
    assert sum(len(r.ids) for r in rows) == sum(r.length for r in got if r.doc_id is not None and r.doc_id < 9)


def test_bin_completion_is_exact_on_small_cases():
    from functools import lru_cache

    rng = np.random.default_rng(2)
    for _ in range(40):
        items = tuple(sorted(rng.integers(1, 13, rng.integers(1, 9)).tolist(), reverse=True))

        @lru_cache(None)
        def best(rest, rooms):
            if not rest:
                return len(rooms)
            return min([best(rest[1:], tuple(sorted((*rooms[:i], r - rest[0], *rooms[i + 1 :])))) for i, r in enumerate(rooms) if r >= rest[0]] + [best(rest[1:], tuple(sorted((*rooms, 12 - rest[0]))))])

        counts = np.bincount(items, minlength=13)
        found = packing.complete(counts)
        assert packing.lower_bound(counts) <= best(items, ()) == packing.bins(found)
        used = Counter()
        for filled, times in found:
            assert sum(d * k for d, k in filled) <= 12
            used.update({d: k * times for d, k in filled})
        assert used == Counter(items)


def test_ppm_scores_equal_brute_force(docs, texts):
    got = ppm.scored(docs).collect()
    tokens = [(i, [*spaced(fold(t)), "\0"], zlib.crc32(str("" if i is None else i).encode()) % 7 == 2) for i, t in texts]
    count = Counter(w for _, own, held in tokens if not held for w in own)
    total, kinds = sum(count.values()), len(count)
    want = Counter((i, held, len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w), 4)) for i, w, held in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_ppm_rows_are_distributions_with_escape_and_exclusion():
    text = ["abracadabra abracadabra"] * 4
    grams = {}
    for batch in ppm._count(4)(iter([pa.record_batch({"t": pa.array(text)})])):
        for row in batch.to_pylist():
            grams.setdefault(row["kind"], []).append((np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.int64)))
    merged = {k: lexer.totals(np.concatenate([a for a, _ in v]), np.concatenate([b for _, b in v])) for k, v in grams.items() if k != ppm.WORDS}
    model = ppm.Model(merged, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 1, 1)
    assert np.allclose((10.0 ** model.log10.astype(np.float64)).sum(axis=1), 1, atol=1e-3)
    # After "ra" + "c" or "ra" + " " or the end; order 5 context "dabra" saw a space and the end four times each.
    node = 0
    for byte in reversed(b"dabra"):
        node = int(model.child[node, byte])
    assert math.isclose(10 ** model.log10[node, 32], (4 - 0.5) / 8, rel_tol=1e-4) and math.isclose(10 ** model.log10[node, 0], (4 - 0.5) / 8, rel_tol=1e-4)


def test_mixture_meets_its_marginals(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(5, 300))), ["en", "de", None][int(rng.integers(0, 3))], f"s{min(int(rng.integers(0, 9)), 5)}", 0) for i in range(3000)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), budget=0.3, rounds=30).toPandas()
    assert got.probability.max() < 1
    got["w"] = got.tokens * got.probability
    for column in ("source", "lang", "topic"):
        share, all_of = got.groupby(column).w.sum() / got.w.sum(), got.groupby(column).tokens.sum() ** mixing.ALPHA[column]
        assert np.allclose(share, all_of / all_of.sum(), atol=1e-6)
    assert abs(got[got.kept].tokens.sum() / got.tokens.sum() - 0.3) < 0.03


def test_mixture_defines_awkward_rows(docs, texts):
    got = mixing.mixed(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in texts)
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.sample(docs).count() == sum(r.kept for r in got)


def test_many_languages_and_topics_are_raked_in_tables(docs, monkeypatch):
    cells = lambda: Counter((r.source, r.lang, r.topic, round(r.probability, 9)) for r in mixing.mixed(docs, rounds=3).collect())
    few = cells()
    monkeypatch.setattr(mixing, "MAX_PAIRS", 1)
    assert cells() == few and mixing.mixed(docs.limit(0)).count() == 0


def test_stages_keep_columns_of_any_name(spark, docs):
    names = "host_key host_rules probability pair __source __LANG __tokens __score __n_words __kept __other __host".split()
    unique = docs.where("doc_id < 10 or doc_id >= 100").dropDuplicates(["doc_id"])
    wide = unique.withColumns({n: F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")) for n in names})
    marks = labels(spark, docs, lambda t: int(len(t) > 300))
    stages = [hostrules.keep_good, lambda d: quality.keep_good(d, marks), jaccard.one_of_each, mixing.sample]
    for stage in stages:
        got = stage(wide)
        assert got.columns == wide.columns
        rows = got.collect()
        assert {r.doc_id for r in rows} == {r.doc_id for r in stage(unique).select("doc_id").collect()}
        assert all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in names)


def test_empty_tables(spark):
    none = empty(spark)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    frames = [jaccard.similar_components(none), hostrules.document_verdicts(none), quality.scored(none, marks), toxicity.scored(none, marks), packing.pack(none, vocabulary()), ppm.scored(none), mixing.mixed(none), mixing.sample(none), hostrules.keep_good(none), quality.keep_good(none, marks), jaccard.one_of_each(none)]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_ppm_keeps_every_context_whatever_the_corpus(spark, docs, texts, monkeypatch):
    data = {i: b"\0" * 5 + bytes(max(b, 1) for b in fold(t or "").encode()) + b"\0" for i, t in texts if i not in (None, 11, 12)}
    trie = {}
    for i, t in texts:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            raw = b"\0" * 5 + bytes(max(b, 1) for b in fold(t or "").encode()) + b"\0"
            for at in range(5, len(raw)):
                for order in range(6):
                    trie.setdefault(raw[at - order : at], Counter())[raw[at]] += 1

    def log10(context, symbol):
        lead, out = 0.0, set()
        for order in range(5, -1, -1):
            seen = trie.get(context[5 - order :])
            if seen is None:
                continue
            here = {s: n for s, n in seen.items() if s not in out}
            every = max(sum(here.values()), 1)
            escape = len(here) / 2 if len(seen) < 256 else 0
            if symbol in here:
                return lead + math.log10((here[symbol] - (escape > 0) / 2) / every)
            lead += math.log10(escape / every) if here else 0
            out |= seen.keys()
        return lead - math.log10(256 - len(out))

    once = {}
    want = {i: sum(once[x] if x in once else once.setdefault(x, log10(x[:5], x[5])) for x in (raw[at - 5 : at + 1] for at in range(5, len(raw)))) for i, raw in data.items()}
    for heavy in (ppm.HEAVY_GRAMS, 50):
        monkeypatch.setattr(ppm, "HEAVY_GRAMS", heavy)
        got = {r.doc_id: r.score for r in ppm.scored(docs).collect() if r.doc_id in data}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-5, abs_tol=1e-3) for i in want)


def test_bin_completion_finds_planted_triplets():
    for seed in range(3):
        rng = np.random.default_rng(seed)
        items = []
        for _ in range(20):
            a = int(rng.integers(256, 400))
            b = int(rng.integers(256, 1024 - a - 256 + 1))
            items += [a, b, 1024 - a - b]
        counts = np.bincount(items, minlength=1025)
        found = packing.complete(counts)
        used = Counter()
        for filled, times in found:
            assert sum(d * k for d, k in filled) <= 1024
            used.update({d: k * times for d, k in filled})
        assert used == Counter(items) and packing.bins(found) == 20
