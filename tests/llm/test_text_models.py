"""Tokens, language, rules and language model on edge cases and against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slicewise.llm import arrays, bpe, brown, language_id, piece_counts, queries, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "it's 'sure ''s x'd we'll\r\n  now",
    "tabs\tand  spaces \n\n end ",
    "▁mark ▁▁ marks\n ▁",
    "日本 é  　 ß 😀 x² 12ab",
    "<|endoftext|>a <|endoftext|><|endof text|> <s> </s> <unk>",
    "word " * 4000,
    "x" * 20_000,
    " line\x1csep\x85",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(TEXTS)] + [(3, "one", None, None, None), (None, "one", "de", "b", 2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_words_match_the_pattern():
    texts = [t or "" for t in TEXTS] + ["A bC\x0bD", ""]
    got = []
    for _, _, data, rows in arrays.pieces(pa.array(texts), 64):
        values, before = arrays.words(data, rows)
        listed = [v.decode() for v in values.to_pylist()]
        got += [listed[a:b] for a, b in zip(before[:-1], before[1:])]
    assert got == [WORD.findall(lower(t)) for t in texts]


def test_hashes_depend_on_content_alone():
    a = arrays.hashes(pa.array([b"ab", b"", b"\0", b"ab"], pa.large_binary()))
    b = arrays.hashes(pa.array([b"zzz", b"ab"], pa.large_binary()))
    assert a[0] == a[3] == b[1] and len(set(a.tolist())) == 3


# ---- BPE


@pytest.fixture(scope="module")
def vocabulary_file():
    return open(queries.tokenizer_file("byte_bpe_50k.json"), encoding="utf-8").read()


def test_bpe_as_the_library(docs, vocabulary_file):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_str(vocabulary_file)
    found = bpe.encode(docs.withColumn("n_tokens", F.lit("clash")), vocabulary_file, ids=True, decode=True).collect()
    assert len(found) == len(TEXTS) + 2
    for r in found:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False) == (r.text or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_bpe_of_random_texts(vocabulary_file):
    tokenizers = pytest.importorskip("tokenizers")
    library, encoder = tokenizers.Tokenizer.from_str(vocabulary_file), bpe.Encoder(bpe.Vocabulary(vocabulary_file))
    rng = np.random.default_rng(5)
    parts = ["a", "the", " ", "  ", "\n", "'s", "'re", "'", "1", "é", "!", "?? ", "<|endoftext|>", "<|endof", "text|>", "　", "日本", " 's"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(2000)]
    got = []
    for _, _, data, rows in arrays.pieces(pa.array(texts), 4096):
        got += [bytes(ids).decode() for _, ids, _ in encoder.texts(encoder.looked_up(data, rows))]
    assert got == [",".join(map(str, library.encode(t, add_special_tokens=False).ids)) for t in texts]


def test_segment_tree_gives_the_leftmost_lowest_pair():
    leaves = np.array([[5, 3, 9, 3], [7, 7, 1, 1000]]) << 3 | np.arange(4)
    trees = bpe.Trees(leaves.copy())
    assert (trees.root(np.arange(2)) & 7).tolist() == [1, 2]
    trees.put(np.array([0, 1]), np.array([1, 2]), np.array([bpe.NONE, bpe.NONE]))
    assert (trees.root(np.arange(2)) & 7).tolist() == [3, 0]


def test_bpe_of_an_empty_table(empty, vocabulary_file):
    assert bpe.encode(empty, vocabulary_file).count() == 0


# ---- token counts


@pytest.fixture(scope="module")
def model():
    return open(queries.tokenizer_file("piece_bpe_32k.model"), "rb").read()


def test_counts_as_the_library(docs, model, monkeypatch):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    monkeypatch.setattr(piece_counts, "FREQUENT", 3)  # most pre-tokens take the join
    found = piece_counts.count_tokens(docs, model).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found), key=str)
    want = []
    for r in docs.collect():
        n = len(library.encode(r.text or ""))
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 4096))
    assert got == sorted(want, key=str)


def test_counts_of_random_texts(model):
    sentencepiece = pytest.importorskip("sentencepiece")
    library, cut = sentencepiece.SentencePieceProcessor(model_proto=model), piece_counts.Rules(model)
    rng = np.random.default_rng(6)
    parts = ["a", "the", " ", "  ", "\n", "\t", "▁", "é", "<s>", "<0x41>", "日本", "😀", "\x00", " the", "ing"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(2000)]
    got = []
    for _, _, data, rows in arrays.pieces(piece_counts.leading(pa.array(texts)), 4096):
        found, before = cut.tokens(data, rows)
        got += arrays.row_sums(np.array(cut.counts(found.to_pylist()), np.int64), before).tolist()
    assert got == [len(ids) for ids in library.encode(texts)]


def test_counts_of_an_empty_table(empty, model):
    assert piece_counts.count_tokens(empty, model).count() == 0


# ---- language


def test_language(spark):
    rng = np.random.default_rng(1)
    letters = {"aa": "abcde", "bb": "lmnop"}
    rows = []
    for i in range(60):
        lang = ["aa", "bb"][i % 2]
        words = ["".join(rng.choice(list(letters[lang]), 5)) for _ in range(30)]
        rows.append((i, " ".join(words).upper() if i % 3 == 0 else " ".join(words), lang))
    extra = [(100, None, "aa"), (101, "12 !?", "bb"), (102, "", None), (102, "", None), (None, "abcde abcde", "bb")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    held = docs.withColumn("held", language_id.held_out("doc_id"))
    assert all(r.held == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held.collect())
    prototypes = language_id.learn(held.where("not held"))
    found = language_id.predict(docs, prototypes).collect()
    assert len(found) == len(rows) + len(extra)
    for r in found:
        assert 0 <= r.score <= 1
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert r.lang_pred == "und" and r.score == 0
        elif r.doc_id is not None:
            assert r.lang_pred == r.lang
    assert {r.lang_pred for r in language_id.predict(docs, {}).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), language_id.learn(docs.limit(0))).count() == 0


def test_bundles_are_sums_of_bound_trigrams():
    space = language_id.Space(64)
    ((first, end, got),) = space.bundles(np.frombuffer("Ab c".encode(), np.uint8), np.array([0, 4]))
    vector = {c: space.vectors[int(space.letters(np.array([ord(c)], np.uint32))[0])] for c in "abc"}
    vector[" "] = space.vectors[0]
    want = sum(np.roll(vector[x], 2) * np.roll(vector[y], 1) * vector[z] for x, y, z in (" ab", "ab ", " c "))
    assert (first, end) == (0, 1) and np.array_equal(got[0], want)


# ---- rules


def measured(text):
    words = WORD.findall(text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {p for v in windows.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_rules_against_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [t for t in TEXTS] + [" ".join(rng.choice(list("abc"), int(rng.integers(1, 90)))) for _ in range(60)]
    texts += ["a b c d e f g h i a b c d e f g h", "x\ny\nx\n\nx", "# | <b> & $5 * 1%"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, n_words string")
    for r in rules.ledger(docs).collect():
        n, chars, symbols, dup, repeat = measured(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert bool(r.failed & rules.BASE.mask) == (n < 20 or 100 * repeat > 30 * n)
    assert rules.ledger(docs.limit(0)).count() == 0


def test_ablation_counts_each_rule(spark):
    rows = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "failed long")
    policy = rules.Policy("p", ("few_words", "repeated_windows"))
    got = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in rules.ablation(rows, (policy,)).collect()}
    assert got == {"few_words": (3, 2, 4), "repeated_windows": (1, 0, 2)}


# ---- language model


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(brown, "FREQUENT", 40)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["der", "Hund"] if i % 2 else ["the", "dog", "cat"], 12))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "unseen words entirely"), (202, "the the"), (None, "the dog"), (203, "x " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    found = brown.score(docs).collect()
    assert len(found) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall(lower(t or "")), None]
    counts = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total = sum(counts.values())
    want = []
    for i, t in rows:
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens(t))
        want.append((str(i), held(i), len(tokens(t)), sum(w in counts for w in tokens(t)), total, round(base, 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found]
    assert sorted(got) == sorted(want)
    regular = [r for r in found if r.doc_id is not None and r.doc_id < 150 and r.held_out]
    assert sum(r.score for r in regular) > sum(r.base_score for r in regular)
    assert brown.score(docs.limit(0)).count() == 0


def test_classes_of_all_words_and_scores_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(brown, "CORE", 6)
    monkeypatch.setattr(brown, "FREQUENT", 9)
    rng = np.random.default_rng(6)
    kinds = [[f"n{i}{i % 7}" for i in range(60)], [f"v{i}{i % 5}" for i in range(60)], ["the", "a", "of", "in"]]
    line = lambda: " ".join(str(rng.choice(kinds[k])) for _ in range(int(rng.integers(1, 8))) for k in (2, 0, 1))
    rows = [(i, line()) for i in range(120)] + [(500, "The unseen n00"), (501, None), (502, "v00 v11 v22 n33")]
    seen, exchange = [], brown.word_classes

    def kept(texts, core, classes, left):
        words, matrix = exchange(texts, core, classes, left)
        seen.append((core, classes, words.collect(), matrix))
        return words, matrix

    monkeypatch.setattr(brown, "word_classes", kept)
    found = brown.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    core, classes, words, matrix = seen[0]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    tokens = lambda t: [*(w.encode() for w in WORD.findall(lower(t or ""))), b""]
    counts = collections.Counter(w for i, t in rows if i not in held for w in tokens(t))
    assert {bytes(r.word): r.n for r in words} == counts and len(words) == len(counts)
    c = {bytes(r.word): r.c for r in words}
    history = lambda w: classes[core.index(w) if w in core else brown.CORE + brown.endings([w])[0]]
    assert all(c[w] == history(w) for w in core)
    want, start = np.zeros((2, brown.CLASSES, brown.CLASSES))
    for i, t in rows:
        for v, w in zip([b"", *tokens(t)], tokens(t)) if i not in held else ():
            want[history(v), c[w]] += 1
            start[history(v), history(w)] += 1
    assert (want == matrix).all()
    assert brown.likelihood(matrix) > brown.likelihood(start) and any(c[w] != history(w) for w in c)
    sizes = np.zeros(brown.CLASSES)
    for w, n in counts.items():
        sizes[c[w]] += n + 1
    step = (want + brown.ALPHA) / (want + brown.ALPHA).sum(1, keepdims=True)
    for r in found:
        total = 0.0
        text = dict(rows)[r.doc_id]
        for v, w in zip([b"", *tokens(text)], tokens(text)):
            if w in counts:
                total += math.log10(step[history(v), c[w]] * (counts[w] + 1) / (sizes[c[w]] + 1))
            else:
                total += math.log10((step[history(v)] / (sizes + 1)).sum())
        assert math.isclose(r.score, total, abs_tol=1e-6)


def test_each_word_moves_to_the_class_of_the_highest_likelihood():
    rng = np.random.default_rng(7)
    codes, history = np.sort(rng.integers(0, 30, 400)), rng.integers(0, brown.CLASSES, 400)
    values = pa.array([bytes([65 + i]) for i in range(30)], pa.large_binary())
    _, n, packed = brown.cells(codes, history, np.ones(400), values)
    own = rng.integers(0, 6, len(n))
    matrix = rng.integers(0, 40, (brown.CLASSES, brown.CLASSES)).astype(float)
    np.add.at(matrix, (history, own[np.unique(codes, return_inverse=True)[1]]), 1)
    best = brown.chosen(packed, n.to_numpy(), own, matrix)
    for word, code in enumerate(np.unique(codes)):
        values = []
        for c in range(brown.CLASSES):
            changed = matrix.copy()
            np.subtract.at(changed, (history[codes == code], own[word]), 1)
            np.add.at(changed, (history[codes == code], c), 1)
            values.append(brown.likelihood(changed))
        assert values[best[word]] >= max(values) - 1e-6


def test_words_alike_are_looked_at_once(monkeypatch):
    seen, one = [], brown._chosen
    monkeypatch.setattr(brown, "_chosen", lambda column, *rest: seen.append(len(column)) or one(column, *rest))
    matrix = np.random.default_rng(3).integers(0, 40, (brown.CLASSES, brown.CLASSES)).astype(float)
    cell = [(1 * brown.CLASSES + h).to_bytes(8, "little") for h in (5, 9)]
    own = np.array([0, 1, 0, 0] * 500)
    column = pa.array([cell[0], cell[0], cell[1], cell[0]] * 500, pa.binary())
    best = brown.chosen(column, np.ones(2000, np.int64), own, matrix)
    assert sum(seen) == 3 and best.tolist() == one(column, np.ones(2000, np.int64), own, matrix).tolist()


def test_endings_by_definition():
    words = [b"", b"a", b"ab", b"abc", b"xabc", "é".encode(), b"zz"]
    got = brown.endings(pa.array([b"cut", *words], pa.binary())[1:]).tolist()
    assert got == brown.endings(words).tolist() and got[3] == got[4]
    code = np.array([int.from_bytes(w[-3:], "big") + 1 for w in words], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert got == (arrays.mixed(code) % np.uint64(brown.TAILS)).astype(int).tolist()


def test_probabilities_of_all_words_add_up_to_one():
    rng = np.random.default_rng(4)
    classes = rng.integers(0, brown.CLASSES, brown.CORE + brown.TAILS)
    counts = rng.integers(1, 50, 500)
    of = rng.integers(0, brown.CLASSES, 500)
    sizes = np.stack([np.bincount(of, counts, brown.CLASSES), np.bincount(of, minlength=brown.CLASSES)])
    model = brown.Model([], classes, rng.integers(0, 30, (brown.CLASSES, brown.CLASSES)).astype(float), sizes)
    total = (10 ** model.known[:, of] * (counts + 1)[None, :]).sum(1) + 10**model.unknown
    assert np.allclose(total, 1)


def test_exchanges_raise_the_likelihood():
    rng = np.random.default_rng(5)
    units = np.where(np.arange(6000) % 2 == 0, rng.integers(0, 20, 6000), rng.integers(20, 40, 6000))
    classes, values = rng.integers(0, 3, 40), []
    for _ in range(4):
        left, right = np.zeros((40, brown.CLASSES), np.int64), np.zeros((40, brown.CLASSES), np.int64)
        np.add.at(left, (units[1:], classes[units[:-1]]), 1)
        np.add.at(right, (units[:-1], classes[units[1:]]), 1)
        values.append(brown.likelihood(brown.class_matrix(right, classes)))
        classes = brown.exchanged(left, right, classes)
    assert max(values) > values[0]
    assert not set(classes[:20]) & set(classes[20:])  # words of even places are never in a class with those of odd ones


def test_language_vectors_need_bounded_memory():
    """Texts are bundled in small pieces, whose arrays take many times the bytes of the texts."""
    import tracemalloc

    space = language_id.Space(language_id.DIMENSIONS)
    texts = pa.array([f"word{k % 97} other{k % 89} " * 40 for k in range(5000)])
    tracemalloc.start()
    for _, _, data, rows in arrays.pieces(texts, language_id.PIECE_BYTES):
        for _ in space.bundles(data, rows):
            pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
