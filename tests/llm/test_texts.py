import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylight.llm import leakage, neardup, packing, stuffing


def shingles(text, n):
    w = re.findall("[a-z0-9_]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def corpus(seed, size=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(size):
        if i and rng.random() < 0.6:
            text = rng.choice(out).split()
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append(" ".join(text))
        else:
            out.append("the common start of all " + " ".join(rng.choice(words) for _ in range(rng.randint(3, 60))))
    return out


@pytest.mark.parametrize("seed, t, n", [(1, 0.7, 3), (2, 0.5, 2), (3, 0.9, 3), (4, 0.8, 5)])
def test_near_duplicates_are_exact(spark, seed, t, n):
    texts = corpus(seed)
    rows = [(i, x, "clash") for i, x in enumerate(texts)] + [(500, None, ""), (501, "", ""), (502, "one two", ""), (None, texts[0], ""), (0, texts[0], ""), (503, texts[1].upper(), "")]
    nd = neardup.NearDuplicates(spark.createDataFrame(rows, "id long, text string, doc string"), "id", "text", n, t)
    sets = {i: shingles(x, n) for i, x, _ in rows if i is not None and x}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}
    got = {(r["key_a"], r["key_b"]): r["similarity"] for r in nd.pairs().collect()}
    assert got == pytest.approx(want) and set(got) == set(want)
    group = {r["key"]: r["group"] for r in nd.groups().collect()}
    assert set(group) == {i for i, s in sets.items() if s}
    assert all(group[a] == group[b] for a, b in want)
    least = dict.fromkeys(group)
    for k in sorted(group):
        least[k] = min(x for x in group if group[x] == group[k])
    assert least == group


def test_hot_column_in_blocks(spark):
    texts = [f"alpha beta gamma x{i} y{i}" for i in range(120)] + ["alpha beta gamma"] * 5
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, text string")
    rows = neardup.records(df, "id", "text", 3).groupBy("doc").agg({"size": "first", "grams": "first"}).toDF("doc", "a", "b")
    kinds = dict(rows.dtypes)
    docs = rows.select("doc", *[(rows[c].alias("grams") if kinds[c].startswith("array") else rows[c].alias("size")) for c in ("a", "b")])
    got = neardup.similar_sets(docs, 0.3, block=8).count()
    sets = list({frozenset(shingles(x, 3)) for x in texts})
    assert got == sum(len(a & b) / len(a | b) >= 0.3 for a, b in itertools.combinations(sets, 2))


def test_no_records(spark):
    nd = neardup.NearDuplicates(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert nd.pairs().count() == 0 and nd.groups().count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 10))
def test_best_fit_never_overfills(sizes, limit):
    bins, filled = packing.OpenBins(64, limit), {}
    for s in sizes:
        b = bins.put(s)
        fitting = [64 - x for x in filled.values()]
        filled[b] = filled.get(b, 0) + s
        assert filled[b] <= 64 and bins.open <= limit and (b < len(filled) or not fitting)
    assert bins.made == len(filled)


def test_best_fit_takes_the_tightest():
    bins = packing.OpenBins(10, 8)
    assert [bins.put(s) for s in (7, 5, 3, 5, 10, 2)] == [0, 1, 0, 1, 2, 3]


def test_pack(spark):
    sized = spark.createDataFrame([(i, s, "x") for i, s in enumerate([3, 20, 7, 0, None, 10, 25, 1])] + [(1, 20, "x")], "doc_id long, tokens int, bin string")
    budgets = spark.createDataFrame([(1, "a", 10), (2, "b", 8), (2, "b", 8), (3, "c", 0), (4, "d", None)], "budget_id int, budget_name string, capacity_tokens int")
    got = packing.pack(sized, budgets).collect()
    for b, cap in ((1, 10), (2, 8)):
        mine = [r for r in got if r["budget_id"] == b]
        fill, length = {}, {}
        for r in mine:
            fill[r["packer"], r["bin"]] = fill.get((r["packer"], r["bin"]), 0) + r["tokens"]
            length[r["doc_id"]] = length.get(r["doc_id"], 0) + r["tokens"]
            assert r["start"] == r["piece"] * cap and (r["tokens"] == cap or r["start"] + r["tokens"] in (3, 20, 7, 10, 25, 1))
        assert max(fill.values()) <= cap and length == {0: 3, 1: 40, 2: 7, 5: 10, 6: 25, 7: 1}
    assert {r["budget_id"] for r in got} == {1, 2}
    assert packing.pack(sized.limit(0), budgets).count() == 0 and packing.pack(sized, budgets.limit(0)).count() == 0


def test_token_counts_round_trip(spark):
    texts = ["Hello world, this is a test.", "", None, "naïve café — 東京", "a" * 20000, "<|endoftext|>"]
    got = {r["doc_id"]: r["tokens"] for r in packing.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    enc = packing.encoder(packing.TOKENIZERS)
    assert set(got) == {0, 3, 4, 5} and all(enc.decode(enc.encode_ordinary(texts[i])) == texts[i] and got[i] == len(enc.encode_ordinary(texts[i])) for i in got)


def slow_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    run, best, longest = np.zeros_like(h), 0, 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (leakage.MATCH if x == y else leakage.MISMATCH), h[i - 1, j] - leakage.GAP, h[i, j - 1] - leakage.GAP)
            run[i, j] = run[i - 1, j - 1] + 1 if x == y else 0
            best, longest = max(best, h[i, j]), max(longest, run[i, j])
    return best, longest


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), min_size=1, max_size=12)), min_size=1, max_size=5))
def test_alignment(pairs):
    score, run = leakage.align([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    assert [(int(s), int(r)) for s, r in zip(score, run)] == [slow_alignment(a, b) for a, b in pairs]


def test_leaks(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(60)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = {i: make(rng.choice([4, 11, 12, 30, 60])) for i in range(12)}
    docs = {}
    for d in range(80):
        text = make(rng.randint(0, 150))
        if d % 3 == 0:
            w = items[d % 12]
            at = rng.randint(0, max(0, len(w) - 12))
            cut = w[at : at + rng.choice([6, 11, 12, 20, 60])]
            text[len(text) // 2 : len(text) // 2] = cut
        docs[d] = text
    df = spark.createDataFrame([(d, "! ".join(t).title(), 1) for d, t in docs.items()] + [(90, None, 1), (91, "", 1), (None, " ".join(items[3]), 1), (0, " ".join(docs[0]), 1)], "doc_id long, text string, item_id int")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(50, None), (51, ""), (None, "a b c d e f g h i j k l m"), (3, " ".join(items[3]))], "item_id long, text string")
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = {(d, i) for d, t in docs.items() for i, w in items.items() if runs(t, 12) & runs(w, 12)}
    for hot in (10_000, 0):
        monkeypatch.setattr(leakage, "HOT", hot)
        got = leakage.leaks(df, it).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got if r["longest_run"] >= 12} == want and want
        assert all(0 <= r["score"] <= 1 for r in got)
    assert leakage.leaks(df.limit(0), it).count() == 0 and leakage.leaks(df, it.limit(0)).count() == 0


def test_long_edited_copies_are_aligned_whole(spark):
    rng = random.Random(12)
    item = [f"q{rng.randrange(5000)}" for _ in range(400)]
    copy = item[:20] + [w if i % 4 else f"z{i}" for i, w in enumerate(item[20:380])] + item[380:]
    other = [f"y{i}" for i in range(900)]
    docs = {1: other[:300] + copy + other[300:], 2: other[:50] + item[:20] + other[50:700] + item[380:] + other[700:], 3: other}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")
    it = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in leakage.leaks(df, it).collect()}
    for d in (1, 2):
        whole, _ = leakage.align([leakage.word_hashes(" ".join(docs[d]))], [leakage.word_hashes(" ".join(item))])
        assert got[d] == pytest.approx(whole[0] / (2 * len(item)), abs=1e-9)
    assert got[1] > 0.6 and 3 not in got


def test_spans_reach_every_alignment_through_a_seed():
    assert leakage.spans([(100, 10), (130, 40)], 50) == [(10, 220)]
    assert leakage.spans([(0, 0), (5000, 0)], 10) == [(0, 30), (5000, 5030)]


def test_bit_filter(spark):
    values = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 3000)
    held = leakage.bit_filter(spark.createDataFrame([(int(x),) for x in values[:2000]], "x long"))
    assert held.has(values[:2000].view(np.uint64)).all() and held.has(values[2000:].view(np.uint64)).mean() < 0.1
    assert not leakage.bit_filter(spark.createDataFrame([], "x long")).has(values.view(np.uint64)).any()


PROSE = "The loader reads every file below the folder and keeps a column for each. When the cache grows past the limit, the oldest entry is dropped before another one comes in, so readers never wait.\n\n"
STUFFED = ["rust indexer fast rust indexer cheap rust search rust indexer best rust search fast rust indexer " * 6, "Buy rust indexer today, rust indexer cheap, rust indexer fast, rust indexer near you. Looking for rust indexer? Our rust indexer is the best rust indexer for rust indexer. " * 4, "".join(f'<a href="https://x{i}.example/a">rust {w}</a> ' for i, w in enumerate("abcdefghijklmnop")), "".join(f"- [rust {w}](https://x.example/{w})\n" for w in "abcdefghijklmnop"), "".join(f"https://x{i}.example/a/b\n" for i in range(12)), " ".join(f"#tag{i}dev" for i in range(40)), "".join(f"item-{i} 4.{i}/5 ${i}7 [cheap] [rust {w} tool] [fast]\n" for i, w in enumerate("abcdefghijklm"))]
CLEAN = [PROSE * 3, "", None, "  \n", "```\n" + "x.y(1);\n" * 60 + "```\n", "Index of symbols\n\n" + "".join(f"Cart{i}::total_{i}  shop/cart{i}.rs:{i}7\n" for i in range(30)), "".join(f"- [tool{i}](https://x.example/{i}) - The loader of this one keeps the {w} open until it is done.\n" for i, w in enumerate("abcdefghij")), "# Changelog\n\n" + "".join(f"- The reader now skips the {w} that nobody has asked for. (#{i}12)\n" for i, w in enumerate("abcdefghij")), "Revisamos 12 archivos y cada error se envía a kibelre. Revisamos 2 archivos y cada error se envía a gapol.", "word", "**cache** - Keeps what was read before.\n\n**index** - Maps a name to the files that hold it.\n"]


@pytest.mark.parametrize("text", STUFFED)
def test_stuffed(text):
    assert stuffing.spam_share(text) > 0.9
    assert stuffing.spam_share(PROSE + text) > 0.5 or len(text) < len(PROSE) * 1.5
    assert stuffing.spam_share(PROSE * 30 + text) < 0.5


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert stuffing.spam_share(text) < 0.3


def test_score_pages(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([STUFFED[0], PROSE, None, "", STUFFED[0] * 300])] + [(None, STUFFED[0], 1), (0, STUFFED[0], 1)], "doc_id long, text string, spam_share int")
    assert sorted((r["doc_id"], r["stuffed"]) for r in stuffing.score_pages(df).collect()) == [(0, True), (0, True), (1, False), (2, False), (3, False), (4, True)]
    assert stuffing.score_pages(df.limit(0)).count() == 0


def test_lag_profile():
    words = "rust index the rust index the rust index the rust index the".split()
    assert stuffing.lag_profile([], 0).tolist() == [0.0]
    profile = stuffing.lag_profile(stuffing.places_of(words), len(words))
    assert profile[2] == pytest.approx(6 / 9) and profile[0] == 0


def test_regular_and_shuffled_repetition_differ():
    regular = [("indexer" if i % 6 == 0 else f"term{i}") for i in range(64)]
    shuffled = regular[:]
    random.Random(4).shuffle(shuffled)
    assert stuffing.stuffed_window(regular) and not stuffing.stuffed_window(shuffled)
    regular, shuffled = (stuffing.places_of(w) for w in (regular, shuffled))
    assert stuffing.gap_spread(regular) == 0 and stuffing.gap_spread(shuffled) > 0.4
    assert stuffing.lag_profile(regular, 64).max() > 2 * stuffing.lag_profile(shuffled, 64).max()


def test_lists_that_start_again_after_many_words():
    keywords = " ".join(f"keyword{i}" for i in range(45)) + " "
    assert stuffing.spam_share(keywords * 6) > 0.9
    assert stuffing.spam_share("\n\n".join(["cheap rust indexer", "fast rust indexer", "best rust indexer"] * 8)) > 0.9


@pytest.mark.parametrize(
    "text",
    [
        "加载器读取文件夹下的每个文件。缓存超过限制时，最旧的条目会被删除。读者从不等待。索引保存名称和位置。搜索先比较向量。结果按分数排序。旧的快照会保留一段时间。下一次更新只读取改变的文件。",
        "加载器 读取 文件夹 下面 的 每个 文件 然后 保存 所有 的 列 以便 以后 的 搜索 可以 直接 比较 这些 向量 而 不用 重新 读取 原来 的 文本 内容 并且 把 结果 按照 分数 排列 出来 给 用户 查看",
        "Загрузчик читает каждый файл в папке и хранит столбец для каждого из них, а когда кэш превышает предел, самая старая запись удаляется до того, как появится новая, чтобы читатели никогда не ждали",
        "Program wczytuje każdy plik z folderu i trzyma dla niego jedną kolumnę, a gdy pamięć przekroczy granicę, najstarszy wpis znika zanim pojawi się nowy, dzięki czemu czytelnicy nigdy nie muszą czekać",
        "ローダーはフォルダの下にあるすべてのファイルを読み、それぞれに列を保持します。キャッシュが上限を超えると、新しい項目が入る前に最も古い項目が削除されます。読者は決して待ちません。",
    ],
)
def test_prose_of_other_languages(text):
    assert stuffing.spam_share(text) == 0
