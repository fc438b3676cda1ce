"""Each operator against a brute-force version, a round trip, or held-out labels; and on odd tables."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliagrid.llm import _links, _rans, chat_format, decontaminate, mixing, ngram_join, paragraph_dedup, queries, quality_rules, token_counts, token_files, toxicity, url_rules
from foliagrid.llm._scratch import Scratch
from foliagrid.llm._text import buffers

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, n_words string"
ODD = [None, "", " ", "\n\n", "one", "one two three four", "a b c d e", "a b c d e", "A B C D E", "x " * 30_000, "é è 👍 \x00 b", "<|im_end|> a  b\t\tc", "same words here " * 40]


def odd(spark, rows=ODD):
    out = [(i, t, "en", None if i % 3 == 0 else f"s{i % 3}", 0, "k", "i", "n") for i, t in enumerate(rows)]
    out += [out[-1]] * 2 + [(None, "a b c d e", None, None, None, None, None, None)] if rows else []
    return spark.createDataFrame(out, SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def texts(spark):
    return {r.doc_id: r.text for r in documents(spark).select("doc_id", "text").collect()}


OPERATORS = {
    "quality": lambda s, d: quality_rules.quality(d),
    "tokens": lambda s, d: token_files.tokens(d),
    "counts": lambda s, d: token_counts.count_tokens(d),
    "mix": lambda s, d: mixing.mix(d),
    "mixed": lambda s, d: mixing.mixed_documents(d),
    "passages": lambda s, d: paragraph_dedup.repeated_passages(d),
    "items": lambda s, d: decontaminate.find_items(d, s.createDataFrame([(1, "a b c d e"), (2, None), (3, "")], "item_id long, text string")),
    "clean": lambda s, d: decontaminate.clean_documents(d, s.createDataFrame([(1, "a b c d e")], "item_id long, text string")),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, s.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int"))),
    "civil": lambda s, d: toxicity.civil_documents(d, toxicity.train(d, s.createDataFrame([], "doc_id long, toxic int"))),
    "similar": lambda s, d: ngram_join.similar_documents(d),
    "one_of_each": lambda s, d: ngram_join.one_of_each(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, name):
    out = OPERATORS[name](spark, odd(spark))
    rows = out.collect()
    if name in ("quality", "tokens", "counts", "mix", "toxicity", "similar"):
        assert len(rows) == len(ODD) + 3
    if name in ("mixed", "clean", "civil", "one_of_each"):
        assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert OPERATORS[name](spark, odd(spark, [])).collect() == []


def quality_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_counts(spark):
    want = {i: quality_by_hand(t) for i, t in texts(spark).items()}
    got = queries.op1_quality_rules(spark, DATA).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == want
    rows = odd(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality(rows).collect()}
    assert got == {i: quality_by_hand(t) for i, t in enumerate(ODD)}


def test_quality_verdicts_and_long_path(spark, monkeypatch):
    got = queries.op1_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert (got.kept == ((got.quality == 1) & ~got.base_failed)).mean() > 0.98
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 3)  # every text is too long for packed keys
    docs = documents(spark).limit(30)
    want = {r.doc_id: quality_by_hand(r.text)[4] for r in docs.collect()}
    assert {r.doc_id: r.n_repeat_words for r in quality_rules.text_counts(docs).collect()} == want


def test_quality_counts_with_mixed_keys(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 61)  # keys of different windows mix in every text
    docs = documents(spark).limit(60)
    want = {r.doc_id: quality_by_hand(r.text)[4] for r in docs.collect()}
    assert {r.doc_id: r.n_repeat_words for r in quality_rules.text_counts(docs).collect()} == want


def test_label_model_by_hand(spark):
    rows = [([2, 0], 30), ([1, 1], 100), ([0, 1], 50), ([2, 2], 20)]
    m = quality_rules.label_model(spark.createDataFrame(rows, "votes array<int>, n long"), 2, 5).first()
    prior, theta = 0.7, [[[0.2, 0.64, 0.16], [0.2, 0.16, 0.64]] for _ in range(2)]
    for _ in range(5):
        good = [n / (1 + math.exp(math.log(1 - prior) + sum(math.log(theta[j][1][v]) for j, v in enumerate(votes)) - math.log(prior) - sum(math.log(theta[j][0][v]) for j, v in enumerate(votes)))) for votes, n in rows]
        total = sum(n for _, n in rows)
        theta = [[[(sum((g if c == 0 else n - g) for (votes, n), g in zip(rows, good, strict=True) if votes[j] == v) + 1) / ((sum(good) if c == 0 else total - sum(good)) + 3) for v in range(3)] for c in range(2)] for j in range(2)]
        prior = (sum(good) + 1) / (total + 2)
    assert math.isclose(m.prior, prior, rel_tol=1e-9) and np.allclose(m.theta, np.array(theta).ravel())


def test_chat_round_trip():
    r = random.Random(1)
    bits = ["<|im_start|>", "<|im_end|>", "\n", "assistant", "<", "\\", "|", "<\\|", "<\\\\|im_end|>", "a", "", "é", "user\n"]
    for _ in range(3000):
        turns = [("".join(r.choices(bits, k=r.randint(0, 3))), "".join(r.choices(bits, k=r.randint(0, 8)))) for _ in range(r.randint(1, 4))]
        rendered = [chat_format.render(*t) for t in turns]
        assert chat_format.parse("".join(x[0] for x in rendered)) == turns
        for (_, text), (formatted, a, b) in zip(turns, rendered, strict=True):
            assert chat_format.unescape(formatted[a:b]) == text
            assert formatted.count("<|") == 2 and formatted.startswith("<|im_start|>") and formatted.endswith("<|im_end|>\n")  # the template's own
    assert chat_format.render("user", "plain <b> text")[0] == "<|im_start|>user\nplain <b> text<|im_end|>\n"
    for wrong in ("<|im_start|>user\nno end", "<|im_start|>user\na <|im_start|>b<|im_end|>\n", "<|im_start|>a<|im_end|>\nb<|im_end|>\n"):
        with pytest.raises(ValueError):
            chat_format.parse(wrong)


def test_chat_sql_on_control_strings(spark):
    r = random.Random(8)
    bits = ["<|im_start|>", "<|im_end|>", "\n", "assistant", "<", "\\", "|", "<\\|", "<\\\\|im_end|>", "a", "", "é", "user"]
    rows = [(c, t, "".join(r.choices(bits, k=r.randint(0, 3))) if r.random() < 0.5 else "assistant", "".join(r.choices(bits, k=r.randint(0, 9)))) for c in range(60) for t in range(r.randint(1, 5))]
    rows += [(99, 0, "assistant", "<|im_end|> word " * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    want = con.sql(f"SELECT * FROM ({chat_format.chat_sql()}) WHERE conv_id >= 0").fetchall()
    assert sorted(map(tuple, chat_format.read_back(chat_format.format_conversations(df)).collect())) == sorted(want)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    names = sorted(want.columns)
    key = lambda f: sorted((tuple(None if v != v else v for v in r) for r in f[names].astype(object).itertuples(index=False, name=None)), key=repr)
    assert sorted(got.columns) == names and key(got) == key(want)


def test_chat_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", None, "x"), (1, 1, None, "b", "x"), (None, 0, "assistant", "c", "x"), (1, 1, None, "b", "x")], "conv_id long, turn long, role string, text string, seq string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.read_back(chat_format.format_conversations(rows)).collect()}
    assert got == {1: (3, 0), None: (1, 1)}
    assert chat_format.read_back(chat_format.format_conversations(rows.limit(0))).collect() == []


def test_rans_round_trip_and_damage():
    r = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 70_000, 200_000):
        ids = (r.zipf(1.2, n) % 50_257).astype(np.uint32)
        image = _rans.pack(ids, np.array([3, 5]), np.array([True, False]), np.array([n, 0]), 17)
        s = _rans.Segment(image)
        assert (s.decode() == ids).all() and s.first == 17 and s.lengths.sum() == n
    assert (s.decode(1, 2) == ids[_rans.BLOCK : 2 * _rans.BLOCK]).all()  # a block alone
    assert len(image) < 2 * n
    with pytest.raises(ValueError):
        _rans.Segment(image[:500] + bytes([image[500] ^ 1]) + image[501:])
    one = np.full(1000, 7, np.uint32)
    assert (_rans.Segment(_rans.pack(one, np.array([1]), np.array([True]), np.array([1000]), 0)).decode() == one).all()


def test_tokens(spark, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_tokenizer())
    start, want = 0, []
    for i, text in sorted(texts(spark).items()):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op3_token_files(spark, DATA).collect())) == want
    odd_texts = ["", " ", "  ", " a", "a ", "a \n b", "a\n\nb c", "x \u3000y z", "it's he'll  ok\n", "a <|endoftext|>b c", "\r\n a b", "a\x1c b", "x², y½! ٣. ab_. a__,", "\nfoo\nbar.\n", "foo,' bar.'s 'll.", "ªº. º.", "Ⅷ. ㍿. ·.", "…", None]
    r = random.Random(1)
    bits = [*"ab1 2\n\t '.,é½٣ \x85\x1c☃×÷Ą ", "'s", "'ll", "  ", "\n\n", "<|endoftext|>", "<|", " the", " '", "don't", "　", "x" * 30]
    odd_texts += ["".join(r.choices(bits, k=r.randint(0, 30))) for _ in range(3000)] + ["é" * 50_000, "a b. " * 50_000]
    encoder = token_files.Encoder(token_files.default_tokenizer())
    for memo in (1 << 20, 50):  # a small memory is emptied all the time
        monkeypatch.setattr(token_files, "MEMO", memo)
        for some in (odd_texts, odd_texts[::-1], odd_texts[:0]):
            ids, n = encoder.encode(*buffers(pa.array(some, pa.large_string())))
            assert [list(x) for x in np.split(ids, np.cumsum(n))[:-1]] == [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in some]


def test_tokens_without_simple_pieces():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_tokenizer())
    for some in (["国際化と地域化", "日本 語"], ["", None], [], ["\n\n"], ["a"], ["\n"], ["語"]):
        ids, n = token_files.Encoder(token_files.default_tokenizer()).encode(*buffers(pa.array(some, pa.large_string())))
        assert [list(x) for x in np.split(ids, np.cumsum(n))[:-1]] == [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in some]


def test_tokens_after_a_wrong_memory():
    encoder = token_files.Encoder(token_files.default_tokenizer())
    texts = buffers(pa.array(["some words to know by heart"], pa.large_string()))
    want = encoder.encode(*texts)[0]
    encoder.words = encoder.words + np.uint64(1)  # as if other pieces had these hashes
    assert (encoder.encode(*texts)[0] == want).all()


def test_tokens_of_other_tokenizers(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(token_files.default_tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    texts = [" it's  odd\n", "12345 a.b", "", "Foo bar"]
    for name, change in (("prefix", {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}), ("lower", {"normalizer": {"type": "Lowercase"}}), ("none", {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}})):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(spec | change))
        encoder, t = token_files.Encoder(str(path)), Tokenizer.from_file(str(path))
        ids, n = encoder.encode(*buffers(pa.array(texts, pa.large_string())))
        assert not encoder.cuts and [list(x) for x in np.split(ids, np.cumsum(n))[:-1]] == [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]


def test_too_many_ids_for_a_table():
    with pytest.raises(ValueError):
        _rans.frequencies(np.ones((1 << _rans.SCALE_BITS) + 1, np.int64))


def test_token_counts(spark):
    scores = token_counts.read_vocabulary(token_counts.default_vocabulary())
    some = dict(list(texts(spark).items())[:25]) | {-1: None, -2: "", -3: " \n x" + "y" * 300 + "z" * 3000, -4: "👍 é  a", -5: "国際化と地域化" * 90 + " " + "国際化と地域" * 80, -6: "ab" * 700 + " " + "ab" * 699}
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()} == {i: token_counts.brute_force(t, scores) for i, t in some.items()}


def test_mix_targets_copies_and_parts(spark):
    p = mixing.mix(documents(spark)).toPandas()
    by = p.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), most=("size", "max"))
    assert math.isclose(by.target.sum(), 1.5 * p["size"].sum()) and (by.target <= 2 * by["size"] + 1e-6).all()
    assert ((by.taken - by.target).abs() <= by.most + 1e-6).all() and p.copies.between(0, 2).all()
    weights = [5, 2, 1]  # sharing what is above the limits again and again comes to the same targets
    target, left = dict.fromkeys(by.index, 0.0), set(by.index)
    rest = 1.5 * p["size"].sum()
    w = {s: weights[i % 3] for i, s in enumerate(sorted(by.index))}
    while left:
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        full = [s for s in left if share[s] > 2 * by["size"][s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * by["size"][s]
            rest -= target[s]
            left.discard(s)
    assert all(math.isclose(target[s], by.target[s], rel_tol=1e-9) for s in by.index)
    same = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.when(F.col("id") % 2 == 0, "a").alias("source"))
    q = mixing.mix(same).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 2 for r in q)
    assert mixing.mixed_documents(same).count() == sum(r.t for r in q) / 2


def test_mix_rows_that_share_an_id(spark):
    rows = [(i % 3 if i % 5 else None, f"word{i % 40} " * (i % 4 + 1), "a" if i % 2 else None, i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row long").repartition(7)
    copies = mixing.mix(docs).toPandas()
    got = mixing.mixed_documents(docs).toPandas()
    assert len(got) == copies.copies.sum() and got.row.value_counts().max() <= 2
    for (i, source), some in copies.groupby(["doc_id", "source"], dropna=False):  # what is taken of each id is what its rows were given
        own = got[(got.doc_id.isna() if i != i else got.doc_id == i) & (got.source.isna() if source is None or source != source else got.source == source)]
        assert own.text.str.split().str.len().sum() == some.taken.sum()
    again = mixing.mixed_documents(docs.repartition(3)).toPandas()
    assert sorted(again.row) == sorted(got.row)


def test_mix_ranks_are_in_order(spark):
    rows = [(i, "a" if i % 3 else None, (i * 7) % 11, i % 2) for i in range(3000)] + [(None, "a", 5, 1)] * 500
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long, row_key long")
    got = mixing.ranked(sizes, Scratch(spark, "t")).toPandas().sort_values(["source", "rank"])
    for _, some in got.groupby("source", dropna=False):
        assert list(some["rank"]) == list(range(len(some)))
        key = list(zip(some["size"], some.doc_id.fillna(10**9), some.row_key, strict=True))
        assert key == sorted(key)


def groups_by_hand(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(n, words=60, seed=2):
    """A chain-like group: many texts near a centre, most pairs on either side of the limit."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(r.randint(0, 3)):
            t[r.randrange(words)] = f"v{r.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("classes", ["usual", "hot"])
def test_ngram_join_large_groups(spark, monkeypatch, classes):
    if classes == "hot":
        monkeypatch.setattr(ngram_join, "HOT_CLASS", 3)
    monkeypatch.setattr(_links.Buckets, "HOLD", 40)
    monkeypatch.setattr(_links, "BLOCK_ROWS", 50)
    r = random.Random(9)
    shared = " ".join(f"s{k}" for k in range(30))
    rows = near_copies(250) + near_copies(120, 25, 3) + [shared + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randint(5, 12))) for _ in range(150)]
    rows += ["tiny", "tiny", "two words", "", None] + [rows[0]] * 40
    r.shuffle(rows)
    rows = list(enumerate(rows))
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == groups_by_hand(rows)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long").repartition(7)
    got = {r.id: r.comp for r in _links.components(links, Scratch(spark, "t"), "c").collect()}
    assert got == dict.fromkeys(range(301), 0) | {1000: 1000, 1001: 1000}


def test_passages(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(5000)] + ["the", "of", "and"] * 600
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, planted = [], set()
    for _ in range(60):
        passage = text(r.choice([51, 55, 70]))
        for _ in range(2):
            planted.add(len(rows))
            rows.append((len(rows), f"{text(r.randint(5, 200))} {passage} {text(r.randint(5, 200))}"))
    rows += [(len(rows) + i, text(r.randint(20, 500))) for i in range(200)]
    line = text(40)
    near = line.split()
    near[39] = "changed"
    rows += [(5000, f"{text(30)}\n{line}\n{text(20)}"), (5001, f"{text(30)}\n{' '.join(near)}\n{text(20)}")]
    got = paragraph_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id for x in got} == planted | {5000, 5001}
    assert {x.removed for x in got if x.doc_id in planted and x.doc_id % 2 == 0} == {False}
    assert {x.removed for x in got if x.doc_id in planted and x.doc_id % 2} == {True}


def test_passages_in_short_lines(spark):
    r = random.Random(15)
    words = [f"w{i}" for i in range(20_000)]
    some = lambda n: r.choices(words, k=n)
    rows, want = [], {}
    for per_line in range(3, 13):
        for _ in range(12):
            passage = some(r.randint(51, 120))
            for shift in (0, r.randint(1, 2)):  # the second copy's lines are broken elsewhere
                head = some(r.randint(20, 90))
                lines = [passage[max(i, 0) : i + per_line] for i in range(-shift, len(passage), per_line)]
                want[len(rows)] = (len(head), len(passage))
                rows.append((len(rows), " ".join(head) + " " + "\n".join(" ".join(x) for x in lines if x) + " " + " ".join(some(40))))
    got = paragraph_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for i, (start, n) in want.items():  # whole, and a near copy at either end may add a few words
        assert any(start - 3 <= x.start_word <= start and start + n <= x.start_word + x.n_words <= start + n + 3 and x.removed == (i % 2 == 1) for x in got if x.doc_id == i), i


def test_paragraphs_by_hand(spark):
    r = random.Random(16)
    words = [f"w{i}" for i in range(20_000)]
    texts, n = [], 0
    for size in [1, 3, 4, 5, 6, 8, 13, 14, 20, 25, 40, 50, 80] * 6:
        line = r.choices(words, k=size)
        near = list(line)
        if n % 2:
            near[r.choice([0, -1, r.randrange(size)])] = f"v{n}"
        n += 1
        texts += [[r.choices(words, k=30), x, r.choices(words, k=30)] for x in (line, near)]
    docs = [(i, "\n".join(" ".join(x) for x in t)) for i, t in enumerate(texts)]
    shingles = lambda x: {tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))}
    jaccard = lambda x, y: len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))
    sure, never, linked = set(), set(), set()
    for i in range(0, len(texts), 2):
        s, n = jaccard(texts[i][1], texts[i + 1][1]), len(texts[i][1])
        (never if n < 5 or s < 0.8 and n < 14 else sure if s > 0.9 else set()).update({i, i + 1})
        linked |= {i, i + 1} if s >= 0.8 and n >= 5 else set()
    got = paragraph_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    whole = {x.doc_id for x in got if x.start_word <= 30 and x.start_word + x.n_words >= 30 + len(texts[x.doc_id][1])}
    assert sure <= whole and not never & {x.doc_id for x in got}
    assert len(linked - sure) >= 20 and len(linked & whole) >= 0.95 * len(linked)
    assert {x.doc_id for x in got if x.removed} & sure == {i for i in sure if i % 2}


def test_decontamination(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(r.choices(words, k=r.randint(9, 60)))) for i in range(40)] + [(40, "one two three")]
    rows, want = [], set()
    for i, (item, text) in enumerate(items):
        rows.append((i, " ".join(r.choices(words, k=r.randint(0, 300))) + "\n" + text.upper() + " " + " ".join(r.choices(words, k=50))))
        want.add((i, item))
        part = text.split()[: max(2, len(text.split()) // 2)]  # half of an item is no match
        rows.append((1000 + i, " ".join(part) + " " + " ".join(r.choices(words, k=100))))
    got = decontaminate.find_items(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want


def test_hamming_index_finds_all():
    r = np.random.default_rng(0)
    prints = r.integers(0, 1 << 63, 500).astype(np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in r.choice(64, n, False))) for n in r.integers(0, 22, 400)]
    probes = np.concatenate([prints[:400] ^ np.array(flips), r.integers(0, 1 << 63, 400).astype(np.uint64)])
    for radius in (decontaminate.RADIUS, 3, 0, 11):
        place, item = decontaminate.HammingIndex(prints, radius).within(probes)
        want = np.argwhere(np.bitwise_count(probes[:, None] ^ prints[None, :]) <= radius)
        assert set(zip(place.tolist(), item.tolist(), strict=True)) == set(map(tuple, want.tolist()))


def test_packed_rows_come_in_order_and_apart(monkeypatch):
    r = np.random.default_rng(2)
    key = r.choice(r.integers(-(1 << 63), 1 << 63, 3_000), 20_000)
    key[:9_000] = key[0]
    id, meta = r.integers(0, 5_000, 20_000), r.integers(0, 3, 20_000)
    batches = [_links.packed(key[i::4], id[i::4], meta[i::4], 64) for i in range(4)]
    assert sum(b.num_rows for b in batches) < 4 * (64 + 20_000 / _links.PACK_ROWS) and max(len(x.as_py()) for b in batches for x in b.column("rows")) <= 24 * _links.PACK_ROWS
    table = pa.Table.from_batches(batches).sort_by("part").combine_chunks()
    several = {k for k, n in zip(*np.unique(key, return_counts=True), strict=True) if n > 1}
    for held in (1 << 20, 700):
        monkeypatch.setattr(_links, "HELD_ROWS", held)
        got = [x for b in _links._unpacked(table.to_batches(max_chunksize=50)) for x in zip(*(b.column(c).to_pylist() for c in ("key", "id", "meta")), strict=True)]
        shift = 1 << 64
        assert got == sorted(got, key=lambda x: (x[0] % shift >> 58, x))
        assert sorted(x for x in got if x[0] in several) == sorted(x for x in zip(key.tolist(), id.tolist(), meta.tolist(), strict=True) if x[0] in several)


def test_bands_of_a_small_task_are_packed_together(monkeypatch):
    r = random.Random(17)
    texts = [" ".join(r.choices([f"w{i}" for i in range(2_000)], k=200)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts + texts[:30] * 2, pa.large_string())], names=["doc_id", "text"])
    p = paragraph_dedup.Paragraphs(next(paragraph_dedup.slices(batch, lower=True))[2])
    docs, seen = paragraph_dedup.doc_hash(np.arange(100))[p.row].tolist(), {}
    for i, doc, keys in zip(p.ids.tolist(), docs, p.bands().T.tolist(), strict=True):
        seen.setdefault(i, (keys, set()))[1].add(doc)
    want = sorted([(k, i, min(d)) for i, (keys, d) in seen.items() for k in keys] + [(keys[0], i, max(d)) for i, (keys, d) in seen.items() if len(d) > 1])
    made = []
    for flush in (paragraph_dedup.FLUSH, 2 * len(seen), 1):
        monkeypatch.setattr(paragraph_dedup, "FLUSH", flush)
        rows = [x.as_py() for b in paragraph_dedup._band_rows(64)([batch]) for x in b.column("rows")]
        assert sorted(map(tuple, np.frombuffer(b"".join(rows), np.int64).reshape(-1, 3).tolist())) == want
        made.append(len(rows))
    assert made[0] <= 64 < made[1] <= 2 * 64 < made[2] <= paragraph_dedup.BANDS * 64


def test_overlaps_shapes_and_agreement_of_many_rows_are_those_of_each():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64) & np.uint64(0xF00000000000003F)) for n in [0, 1, 2, 7, 300, 3_000, *r.integers(0, 40, 60)]]
    ga, gb = sets, sets[::-1]
    column = lambda some, kind=pa.binary(): pa.array([None if x is None else x.tobytes() for x in some], kind)
    want = [len(np.intersect1d(a, b)) for a, b in zip(ga, gb, strict=True)]
    for kind in (pa.binary(), pa.large_binary()):
        assert _links.overlaps(column(ga, kind), column(gb, kind)).tolist() == want
        assert _links.overlaps(column(ga, kind)[3:], column(gb, kind)[3:]).tolist() == want[3:]
    big = [np.sort(r.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (5, 2_000, 2_000)]
    rows = pa.RecordBatch.from_arrays([*[pa.array([1, 2, 3])] * 4, column([big[0], big[1], big[1]]), column([big[0][1:], big[1][::2], big[2]])], names=["a", "b", "na", "nb", "ga", "gb"])
    assert next(_links._overlaps([rows])).column("overlap").to_pylist() == [4, 1_000, 0]
    for some in (sets, [*sets, np.zeros(300, np.uint64)]):
        flat, own = np.concatenate(some), np.repeat(np.arange(len(some)), [len(x) for x in some])
        shapes = _links.set_shapes(own, flat, len(some), 64)
        assert shapes.to_pylist() == [_links.shape(x, 64) for x in some]
        assert (_links.shapes_of(shapes, 64).sum(axis=1) == [len(x) for x in some]).all()
    x = [None, *(r.integers(0, 2, n).astype(np.uint32) for n in [0, 1, 5, *r.integers(0, 9, 80)])]
    y = [*x[40:], *x[:40]]
    same = lambda a, b: next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    assert paragraph_dedup.agreeing(column(x), column(y)).tolist() == [0 if a is None or b is None else same(a, b) for a, b in zip(x, y, strict=True)]


def test_hamming_index_probes_few_windows_that_are_near_none():
    r = np.random.default_rng(1)
    for n in (1, 3, 20):
        prints, probes = (r.integers(0, 1 << 63, k).astype(np.uint64) for k in (n, 20_000))
        probes[:500] = prints[r.integers(0, n, 500)] ^ np.uint64(0x11111111_11111110)
        kept = decontaminate.HammingIndex(prints).possible(probes.view(np.uint16).reshape(-1, 4).T.astype(np.intp))
        near = np.flatnonzero((np.bitwise_count(probes[:, None] ^ prints[None, :]) <= decontaminate.RADIUS).any(axis=1))
        assert set(range(500)) <= set(near.tolist()) <= set(kept.tolist()) and len(kept) < len(near) + 1_600


def items_by_hand(docs, items, threshold=0.8):
    """(doc, item) -> the best similarity of all item-sized windows, by counting."""
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    words = {i: x.lower().split() for i, x in items if x}
    words = {i: w for i, w in words.items() if w}
    own = {i: Counter(grams(w, min(5, len(w)))) for i, w in words.items()}
    df = Counter(g for c in own.values() for g in c)
    weight = lambda g: 1 + math.log((1 + len(own)) / (1 + df[g])) if g in df else 1 + math.log(1 + len(own))
    out = {}
    for d, text in docs:
        w = (text or "").lower().split()
        for i, c in own.items():
            k, n = min(5, len(words[i])), len(words[i]) - min(5, len(words[i])) + 1
            g = grams(w, k)
            if not any(x in c for x in g):
                continue
            for first in range(max(1, len(g) - n + 1)):
                part = Counter(g[first : first + n])
                s = sum(weight(x) * min(part[x], c[x]) for x in part) / sum(weight(x) * max(part[x], c[x]) for x in part.keys() | c.keys())
                if s >= threshold:
                    out[d, i] = max(s, out.get((d, i), 0))
    return out


def test_decontamination_by_all_windows(spark):
    """Edited copies, copies with sentences swapped, repeated items and passages: recall against all windows."""
    r = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(r.choices(words, k=r.choice([9, 15, 22, 30, 44, 50, 60, 100, 180])))) for i in range(90)] + [(90, "one two three"), (91, "a b"), (None, "w1 w2 w3 w4 w5 w6 w7")]
    items += [(92, items[5][1]), (93, None), (94, "")]
    docs = []
    for i, x in items[:91]:
        w = x.split()
        cut = r.randint(len(w) // 4, 3 * len(w) // 4)
        for kind in range(6):
            v = list(w)
            if kind in (1, 2, 3):
                for _ in range(kind if len(w) > 40 else 1):
                    v[r.choice([0, -1, r.randrange(len(v))])] = f"v{r.randrange(10**6)}"
            if kind == 4:
                v = v[cut:] + v[:cut]
            if kind == 5:
                v = v[: -max(1, len(v) // 8)]
            docs.append((len(docs), " ".join([*r.choices(words, k=r.choice([0, 30])), *v, *r.choices(words, k=r.choice([0, 25])), *(v if kind == 0 else [])])))
    docs += [(None, items[3][1].upper()), (None, None), (len(docs), ""), (len(docs) + 1, " ".join([items[7][1]] * 300)), (len(docs) + 2, " ".join(r.choices(words, k=20_000)))]
    want = items_by_hand(docs, items)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.find_items(*frames).collect()}
    assert set(got) <= set(want) and len(set(got)) >= 0.95 * len(want) and len(want) > 250
    assert sum(math.isclose(got[p], want[p], rel_tol=1e-9) for p in got) >= 0.97 * len(got)
    sure = {p for p, s in want.items() if s > 0.999}
    assert sure <= set(got)
    gone = {d for d, _ in got}
    assert sorted(x.doc_id or -1 for x in decontaminate.clean_documents(*frames).collect()) == sorted([i for i, _ in docs if i is not None and i not in gone] + [-1])


def test_decontamination_in_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"a{i} b c d e f{i}") for i in range(7)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x y a{i} b c d e f{i} z") for i in range(7)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 3)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_items(docs, items).collect()} == {(i, i) for i in range(7)}
    assert decontaminate.clean_documents(docs, items).count() == 0


def test_decontamination_same_in_any_blocks(spark, monkeypatch):
    r = random.Random(22)
    words = [f"w{i}" for i in range(3000)]
    common = r.choices(words, k=12)  # in several items, so that weights differ
    items = [(i, " ".join([*r.choices(words, k=48), *common[: i % 3 * 6]])) for i in range(23)] + [(23, "a b"), (24, None), (25, "")]
    docs = []
    for i, x in items[:24]:
        for cut in range(1, 9):
            w = x.split()
            docs.append((len(docs), " ".join([*r.choices(words, k=10), *w[:-cut], *common, *r.choices(words, k=9)])))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = []
    for at_once in (20_000, 7, 3):
        monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", at_once)
        got = decontaminate.find_items(*frames).collect()
        found.append(sorted((x.doc_id, x.item_id, round(x.similarity, 9), x.hamming, x.start_word, x.n_words) for x in got))
    assert found[0] and found[0] == found[1] == found[2]


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 2 = 0"))
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity.score(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    assert got.kept[got.toxic == 0].mean() > 0.995 and (~got.kept[got.toxic == 1]).mean() > 0.85
    assert got.severity.between(0, toxicity.GRADES - 1).all()


def test_toxicity_scores_by_hand(spark):
    from foliagrid.llm._text import Texts, mix

    def number(word, salt=0):
        h = Texts(np.frombuffer(word, np.uint8), np.array([0, len(word)]), False).hashes
        return int((mix(h ^ toxicity.STEM_SALT) if salt else h)[0] >> np.uint64(64 - toxicity.FEATURE_BITS))

    docs = documents(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    got = {r.doc_id: r.severity for r in toxicity.score(docs, model).collect()}
    for i, text in list(texts(spark).items())[:80]:
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").translate(LOWER).encode())
        found = {number(w) for w in words} | {number(w[:4], 1) for w in words if len(w) > 4}
        score = sum(float(model.weights[f]) for f in found)
        assert math.isclose(got[i], sum(1 / (1 + math.exp(t - score)) for t in model.thresholds), rel_tol=1e-6)


def test_ordinal_gradient():
    r = np.random.default_rng(1)
    x = [np.flatnonzero(r.random(6) < 0.4) for _ in range(400)]
    truth = np.array([2.0, 1.0, 0.0, -1.0, 0.5, 0.0])
    score = np.array([truth[f].sum() for f in x]) + r.logistic(size=400)
    grades = np.digitize(score, [0.5, 2.0])
    w, t = toxicity.fit_ordinal(x, grades, 6, 3, penalty=0.01, rounds=1500)
    assert t[0] < t[1] and np.corrcoef(w, truth)[0, 1] > 0.95


def test_ordinal_gradient_by_differences():
    """The fit's likelihood, written down directly, can't be raised by moving any parameter."""
    r = np.random.default_rng(7)
    x = [np.flatnonzero(r.random(5) < 0.5) for _ in range(150)]
    grades = r.integers(0, 4, 150)
    w, t = toxicity.fit_ordinal(x, grades, 5, 4, penalty=0.5, rounds=6000)

    def likelihood(p):
        total = -0.25 * (p[:5] ** 2).sum()
        for f, g in zip(x, grades, strict=True):
            above = [1.0, *[1 / (1 + math.exp(c - p[f].sum())) for c in p[5:]], 0.0]
            total += math.log(above[g] - above[g + 1])
        return total

    p = np.concatenate([w, t])
    for i in range(8):
        moved = [likelihood(p + d * np.eye(8)[i]) for d in (-1e-4, 1e-4)]
        assert abs(moved[1] - moved[0]) / 2e-4 < 0.05


def test_toxicity_of_odd_samples(spark):
    long_text = " ".join(f"w{i}" for i in range(30_000))
    rows = [(i, f"vile word{i % 7}" if i % 2 else f"kind word{i % 7}") for i in range(200)] + [(500, long_text), (501, long_text + " vile")] + [(2, f"other {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(500, 0), (501, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.kept for r in toxicity.score(docs.filter("text like 'vile%' or text like 'kind%' or doc_id = 501"), model).collect()}
    assert all(got[i] == (i % 2 == 0) for i in range(200) if i != 2)
    assert len(toxicity.least_hashed(np.arange(9000, dtype=np.int32))) == toxicity.MOST_FEATURES
    same = toxicity.train(docs, labels.withColumn("toxic", F.lit(1)))
    assert toxicity.score(docs, same).filter("not kept").count() == 0
    few = toxicity.train(docs, labels, most=10)
    assert few.reject_from > 0


def url_by_hand(url, rules, default):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(LOWER)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    return host, path, *(max(fits)[1:] if fits else (None, default))


def test_url_rules(spark, monkeypatch):
    r = random.Random(3)
    names = ["org", "com", "example.org", "m.example.org", "xexample.org", "a.b.c.example.com", "example.com", "example.org.", "", "org.example", "EXAMPLE.org"]
    urls = [f"http{r.choice(['', 's'])}://{r.choice(names)}{r.choice(['', '/', '/es/1', '/en/1', '/en/12?x=/es/', '/de/#a', '?q=1', '#f', '/fr/'])}" for _ in range(800)] + [None, "", "no scheme", "a://b://c/d", "http://h\n.org/es/"]
    rules = [*url_rules.RULES, ("m.example.org", "/en/", "allow"), ("b.c.example.com", "", "block"), ("example.com", "/de/", "allow")]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for at_once in (100_000, 2):
        monkeypatch.setattr(url_rules, "RULES_AT_ONCE", at_once)
        got = url_rules.judge_urls(rows, rules).collect()
        assert {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in got} == {i: url_by_hand(u, rules, url_rules.DEFAULT) for i, u in enumerate(urls)}


def test_url_rules_many_paths(spark):
    r = random.Random(5)
    part = lambda: "".join(r.choices("ab/", k=r.randint(0, 6)))
    rules = list({(h, p): (h, p, r.choice(["allow", "block"])) for h, p in ((r.choice(["x.org", "org", "a.x.org"]), "/" + part()) for _ in range(300))}.values())
    urls = [f"http://{r.choice(['x.org', 'a.x.org', 'b.a.x.org', 'org', 'y.org'])}/{part()}" for _ in range(900)] + ["http://x.org/" + "a" * 100_000, "http://" + "a." * 5_000 + "x.org/ab"]
    rows = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(None, urls[0], "h", "p"), (0, urls[0], "h", "p")], "page_id long, url string, host string, path string")
    got = url_rules.judge_urls(rows, rules).collect()
    assert len(got) == len(urls) + 2
    for x in got:
        assert (x.host, x.path, x.rule, x.verdict) == url_by_hand(urls[x.page_id or 0], rules, url_rules.DEFAULT)
    assert url_rules.judge_urls(rows.limit(0), rules).collect() == []


def test_sweep_from_the_middle():
    sweep = url_rules.Sweep(url_rules.RULES)
    assert sweep.judge("org.example.zzz.", "/es/1")[1] == "example.org/es/"
    assert url_rules.Sweep([]).judge("org.", "/") is None


def mixed_by_hand(rows, seed=0):
    """(doc_id, source, size) -> copies, a document at a time, with exact fractions."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s))
    place = {s: i for i, s in enumerate(sources)}
    size = {s: sum(n for _, x, n in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[place[s] % 3] for s in sources}
    target, left, rest = {}, set(sources), Fraction(150 * sum(size.values()), 100)
    while left:
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        full = [s for s in left if share[s] > 2 * size[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = Fraction(2 * size[s])
            rest -= target[s]
        left -= set(full)
    out = {}
    for s in sources:
        expected = target[s] / size[s] if size[s] else Fraction(0)
        offset = Fraction(((place[s] + 1) * 40_503 + seed * 30_011) % 65_536, 65_536)
        at = offset
        for i, _, n in sorted((x for x in rows if x[1] == s), key=lambda x: (x[2], x[0] is None, x[0])):
            out[i, s, n] = out.get((i, s, n), 0) + math.floor(at + expected) - math.floor(at)
            at += expected
    return out


def test_pipeline_stages_by_hand(spark):
    import corpus_pipeline as c
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, kept = docs.columns, docs
    scratch = Scratch(spark, "test")
    tables = [docs.toPandas()]
    for name, stage in c.STAGES[:-1]:
        kept = scratch.save(stage(spark, kept, DATA), name)
        assert kept.columns == names
        tables.append(kept.toPandas())
    raw, civil, distinct, unseen, mixed = tables
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(docs, labels)
    scores = {r.doc_id: r.severity for r in toxicity.score(docs, model).collect()}
    assert set(civil.doc_id) == {i for i, s in scores.items() if s < model.reject_from} and len(civil) < len(raw)
    by_hand = groups_by_hand(list(zip(civil.doc_id, civil.text, strict=True)))
    assert set(distinct.doc_id) == {i for i, (_, comp) in by_hand.items() if i == comp} and len(distinct) < len(civil)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = items_by_hand(list(zip(distinct.doc_id, distinct.text, strict=True)), items)
    assert set(unseen.doc_id) >= set(distinct.doc_id) - {d for d, _ in found}  # no clean document goes
    sure = {d for (d, _), s in found.items() if s > 0.9}
    assert sure and not sure & set(unseen.doc_id)
    assert len(distinct) - len(unseen) >= 0.9 * len({d for d, _ in found})
    rows = [(i, s, len(WORD.findall(t or ""))) for i, s, t in zip(unseen.doc_id, unseen.source, unseen.text, strict=True)]
    copies = {k: n for k, n in mixed_by_hand(rows).items() if n}
    got = Counter((i, s, len(WORD.findall(t or ""))) for i, s, t in zip(mixed.doc_id, mixed.source, mixed.text, strict=True))
    assert got == copies
    out = c.run(spark, DATA)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    t, want, start = Tokenizer.from_file(token_files.default_tokenizer()), [], 0
    for i, text in sorted(zip(mixed.doc_id, mixed.text, strict=True)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out.collect())) == want


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([(1, "a b c d e"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    more = [(None, "only without id, a text of its own that is long enough", None, None, None, "__gone", "row", "best")] * 2
    table = odd(spark).unionByName(spark.createDataFrame(more, SCHEMA)).withColumnRenamed("key", "__gone").withColumnRenamed("id", "__row").withColumn("row_key", F.lit(1)).withColumn("comp", F.lit("x")).withColumn("rows", F.lit("y"))
    for rows in (table, table.limit(0)):
        kept = rows
        for _, stage in c.STAGES:
            before, kept = kept, Scratch(spark, "test").save(stage(spark, kept, str(tmp_path)), "kept")
            if stage is not c.STAGES[-1][1]:
                assert kept.columns == before.columns
        assert kept.count() == 0 or rows is table


def test_one_of_each_by_row(spark):
    a, b, c = ("one two three four five six seven", "quite another text of enough words here", "a third one that nobody has copied yet")
    rows = [(1, a, "x"), (2, a, "y"), (2, c, "z"), (None, b, "p"), (None, b, "p"), (3, None, "n"), (3, "", "m"), (1, a, "x")]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, __gone string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, a, "x"), (2, c, "z"), (None, b, "p"), (3, None, "n"), (3, "", "m")]))


def test_links_through_rows_without_id(spark):
    """A chain whose middle has no doc_id, against all pairs."""
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(["x"] * 0 + [f"v{j}" if j < k * 2 else w for j, w in enumerate(words)]) for k in range(6)]
    for none in ({1, 4}, {0, 2, 3}):
        rows = [(i, t) for i, t in enumerate(chain)]
        want = groups_by_hand(rows)
        table = spark.createDataFrame([(None if i in none else i, t) for i, t in rows], "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(table).collect() if r.doc_id is not None}
        roots: dict = {}
        for i, (_, comp) in want.items():
            if i not in none:
                roots.setdefault(comp, []).append(i)
        assert got == {i: min(some) for some in roots.values() for i in some}


def test_pairs_by_bands_of_sizes(spark):
    """The last comparison meets every pair whose sizes allow a link, of different components."""
    r = random.Random(12)
    ids = [(i, r.choice([1, 5, 5, 6, 10, 12, 40, 45, 50, 200])) for i in range(300)]
    comps = {i: r.randrange(4) for i, _ in ids}
    rows = spark.createDataFrame([(7, i, 0, comps[i], 300, n, bytearray([n] + [0] * 255)) for i, n in ids], "key long, id long, meta long, comp long, rows long, n long, shape binary")
    got = {(x.a, x.b) for x in _links.last_candidates(rows, lambda a, b: np.ones(len(a), bool), 80, 256, Scratch(spark, "t")).collect()}
    size = dict(ids)
    want = {(a, b) for a, _ in ids for b, _ in ids if a < b and comps[a] != comps[b] and 100 * min(size[a], size[b]) >= 80 * max(size[a], size[b])}
    assert got == want


def test_workers_give_memory_back():
    """What a worker holds after a large batch is what it held before, though small objects lie between."""
    import subprocess
    import sys

    code = """
import re, sys
import numpy as np, pyarrow as pa
from foliagrid.llm import _text

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024

kept = []

def work(batches):
    for batch in batches:
        some = [np.ones(12_000) for _ in range(1_500)]
        kept.append([np.ones(10) for _ in range(10)])
        yield batch.slice(0, len(some) // 1_500)

batch = pa.RecordBatch.from_arrays([pa.array(["x" * 20_000_000])], names=["text"])
before = held()
assert sum(x.num_rows for x in _text.lean(work)(iter([batch] * 3))) == 3
print(held() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env={"PYTHONPATH": ":".join(sys.path), "PATH": "/usr/bin:/bin"})
    assert int(out.stdout.split()[-1]) < 60, out
