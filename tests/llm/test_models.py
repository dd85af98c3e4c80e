"""Language ID, toxicity, quality rules and host reputation: brute force, held-out accuracy, edge cases."""
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def kneser_ney(texts, order=4, discount=0.75, floor=65536):
    """Interpolated Kneser-Ney over padded character sequences, straight from the definition."""
    def symbols(t):
        return "".join(w + " " for w in "".join(c if c.isalpha() else " " for c in t.lower()).split())
    counts = Counter()
    for t in texts:
        s = symbols(t)
        padded = " " * (order - 1) + s
        counts.update(padded[i:i + order] for i in range(len(s)))
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    sums = {k: defaultdict(lambda: [0, 0]) for k in tables}
    for k, t in tables.items():
        for g, c in t.items():
            sums[k][g[:-1]][0] += c
            sums[k][g[:-1]][1] += 1

    def p(g):
        if not g:
            return 1 / floor
        k = len(g)
        total, kinds = sums[k].get(g[:-1], (0, 0))
        if not total:
            return p(g[1:])
        c = tables[k].get(g, 0)
        return max(c - discount, 0) / total + discount * kinds / total * p(g[1:])

    def entropy(t):
        s = symbols(t)
        padded = " " * (order - 1) + s
        return -sum(math.log(p(padded[i:i + order])) for i in range(len(s))) / len(s) if s else None
    return entropy


def test_model_matches_kneser_ney_by_definition(spark):
    from spanweave.llm.langid import train
    rng = random.Random(0)
    rows = [("a", "The cat, the dog & the hat. Über alles"), ("a", "another cat sat on that mat"), ("b", "der hund und die katze"), ("b", "die maus DIE maus"),
            (None, "unlabelled"), ("b", None), ("a", ""), ("b", "12 34"), ("a", "ab" * 40)]
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id bigint, text string, lang string")
    model = train(df, "text", F.col("lang"))
    assert model.langs == ["a", "b"]
    probes = ["the cat", "die katze", "", None, "xyz xyz", "Überall der Hut", "ß", "".join(rng.choice("abc xyzü") for _ in range(500)), "日本", "𝒜𝒷"]
    h, size = model.score(probes)
    for i, x in enumerate(model.langs):
        entropy = kneser_ney([t for y, t in rows if y == x and t])
        for t, got, n in zip(probes, h[:, i], size):
            if t:
                want = entropy(t)
                assert n and want == pytest.approx(got, rel=1e-4), t
            else:
                assert n == 0


def test_language_id_held_out_accuracy_rejection_and_edges(spark):
    from spanweave.llm.langid import held_out, identify, train
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs.where(~held_out()), "text", F.col("lang"))
    right = identify(docs.where(held_out()), model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("accepted").cast("int"))).first()
    assert right[0] > 0.97 and right[1] == 1.0
    odd = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (3, "123 !?", 5.0), (4, "ωορλδ ελλάδα και νησιά στη θάλασσα", 5.0), (5, "the and of that", 5.0),
                                 (5, "the and of that", 5.0)], "doc_id bigint, text string, score double")
    got = sorted(map(tuple, identify(odd, model).select("doc_id", "lang_pred", "accepted").collect()))
    assert got[:3] == [(1, "und", False), (2, "und", False), (3, "und", False)]
    assert got[3][1] in model.langs and not got[3][2] and got[4:] == [(5, "en", True)] * 2
    none = train(docs.limit(0), "text", F.col("lang"))
    assert identify(docs.limit(3), none).select("lang_pred").distinct().collect()[0][0] == "und"
    assert identify(docs.limit(0), model).count() == 0


def test_a_model_beyond_its_bound_is_joined_and_gives_the_same_predictions(spark, monkeypatch):
    from spanweave.llm import langid
    rng = random.Random(5)
    scripts = ["abcdefghij", "klmnopqrst", "αβγδεζηθικ", "абвгдежзик", "一丁七万丈三上下不与"]
    said = [(f"l{i}", "".join(rng.choice(scripts[i % 5] + " ") for _ in range(rng.randrange(20, 400)))) for i in range(12) for _ in range(3)]
    df = spark.createDataFrame([(i, t, x, "own") for i, (x, t) in enumerate(said)], "doc_id bigint, text string, lang string, row string")
    probes = df.drop("lang").unionByName(spark.createDataFrame(
        [(None, None, "a"), (100, "", "b"), (101, "12 !", "c"), (102, "abc αβγ", "d"), (102, "abc αβγ", "d"), (103, "abc " * 9000, "e"), (104, "日本 zzz", "f")],
        "doc_id bigint, text string, row string"))
    monkeypatch.setattr(langid, "_slices", lambda texts, chars=500, whole=langid._slices: whole(texts, chars))
    whole = langid.train(df, "text", F.col("lang"))
    table = langid.train(df, "text", F.col("lang"), max_model_bytes=whole.n_bytes - 1)
    assert len(whole.langs) == 12 and whole.arrays.probs is not None and table.arrays.probs is None
    # every sequence of every language has its own entry
    entries = sum(len(e.value) for e in whole.arrays.probs + whole.arrays.backs)
    assert whole.n_bytes == entries * langid.ENTRY_BYTES
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    want, got = (sorted(langid.identify(probes, m).collect(), key=order) for m in (whole, table))
    assert len(want) == len(got) == 43
    for a, b in zip(want, got):
        assert (a["doc_id"], a["text"], a["row"], a["lang_pred"], a["accepted"]) == (b["doc_id"], b["text"], b["row"], b["lang_pred"], b["accepted"])
        assert a["score"] == pytest.approx(b["score"], abs=1e-3) and a["entropy"] == pytest.approx(b["entropy"], rel=1e-4)


def test_toxicity_learns_pairs_and_holds_out(spark):
    from spanweave.llm.toxicity import fit, score, train
    rng = np.random.default_rng(1)
    x, y = [], []
    for _ in range(3000):  # feature 0 or 1 alone is harmless, both together are not
        row = [j for j in (0, 1) if rng.random() < 0.5] + rng.choice(np.arange(2, 30), 4, replace=False).tolist()
        x.append(np.array(row))
        y.append(float(0 in row and 1 in row))
    bias, weight, vector = fit(x, np.array(y), 30)

    def logit(row):
        v = vector[row]
        return bias + weight[row].sum() + 0.5 * ((v.sum(0) ** 2) - (v ** 2).sum(0)).sum()
    got = np.array([logit(r) > 0 for r in x])
    assert (got == np.array(y, bool)).mean() > 0.99
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    from spanweave.llm.langid import held_out
    machine = train(docs, labels, ~held_out())
    r = score(docs.join(labels, "doc_id").where(held_out()), machine)
    by = {(a["toxic"], a["predicted"]): a["count"] for a in r.groupBy("toxic", "predicted").count().collect()}
    assert by.get((0, 1), 0) <= 0.01 * by[(0, 0)] and by[(1, 1)] >= 0.7 * (by[(1, 1)] + by.get((1, 0), 0))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "idiot " * 5)], "doc_id bigint, text string")
    s = {a["doc_id"]: a["score"] for a in score(odd, machine).collect()}
    assert s[1] == s[2] and all(0 <= v <= 1 for v in s.values())
    empty = train(docs, labels.limit(0), F.lit(True))
    assert score(odd, empty).agg(F.min("score"), F.max("score")).first() == (0.5, 0.5)


def test_quality_measures_and_distances_by_brute_force(spark):
    from spanweave.llm.quality import judge
    rng = random.Random(6)
    vocab = ["the", "of", "and", "longerword", "Übung", "x1", "a.b", "#tag", "12"]
    rows = []
    for i in range(80):
        lines = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(6))]
        lines += rng.sample(lines, min(len(lines), rng.randrange(3)))
        rows.append((i, rng.choice(["en", "de", None]), rng.choice(["\n", " \n"]).join(lines)))
    rows += [(90, "en", None), (91, "en", ""), (92, "de", " \t\n"), (93, "en", "a b c a b c a"), (93, "en", "one\xa0two three"), (94, "fr", "$$$ %% &&&\n$$$ %% &&&")]
    df = spark.createDataFrame([(i, x, t, 1, "s") for i, x, t in rows], "doc_id bigint, lang string, text string, n_words int, short string")
    out = judge(df, common=3, min_chars_judged=1, min_words_judged=1, max_char_distance=0.3, max_word_distance=0.5)
    assert out.columns[:4] == ["doc_id", "lang", "text", "short"]
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, (_, _, t) in enumerate(rows)}

    def classes(t):
        t = t or ""
        kinds = [sum("a" <= c <= "z" for c in t), sum("A" <= c <= "Z" for c in t), sum("0" <= c <= "9" for c in t), sum(c in " \t\n\x0b\x0c\r" for c in t),
                 sum(c in ".,;:!?" for c in t), sum(c in "#*$%&|<>" for c in t), len(t.encode()) - len(t)]
        return [*kinds[:6], kinds[6], max(0, len(t) - sum(kinds[:6]))]
    langs = {x for _, x, _ in rows}
    ref_c = {x: np.sum([classes(t) for _, y, t in rows if y == x], axis=0) for x in langs}
    ref_w, total = {}, {}
    for x in langs:
        c = Counter(w for i, (_, y, _) in enumerate(rows) if y == x for w in words[i] if len(w) <= 5)
        ref_w[x] = sorted(c.items(), key=lambda a: (-a[1], a[0].encode()))[:3]
        total[x] = sum(len(words[i]) for i, (_, y, _) in enumerate(rows) if y == x)

    def distance(p, q):
        part = lambda a, b: a * math.log(2 * a / (a + b)) if a > 0 else 0.0
        return math.sqrt(max(sum(part(a, b) + part(b, a) for a, b in zip(p, q)), 0) / (2 * math.log(2)))
    want = []
    for i, (d, x, t) in enumerate(rows):
        w = words[i]
        win = defaultdict(list)
        for j in range(len(w) - 2):
            win[tuple(w[j:j + 3])].append(j)
        cover = {k for v in win.values() if len(v) > 1 for j in v for k in (j, j + 1, j + 2)}
        lines = [s for s in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
        c = classes(t)
        dc = distance([v / sum(c) for v in c], [v / sum(ref_c[x]) for v in ref_c[x]]) if w else 0.0
        p = [w.count(a) / len(w) for a, _ in ref_w[x]] if w else []
        q = [n / total[x] for _, n in ref_w[x]]
        dw = distance([*p, 1 - sum(p)], [*q, 1 - sum(q)]) if w else 0.0
        want.append((d, len(w), sum(map(len, w)), sum(a in "#*$%&|<>" for a in t or ""), len(lines) - len(set(lines)), len(cover), round(dc, 6), round(dw, 6),
                     not (len(t or "") and dc > 0.3 or w and dw > 0.5)))
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], round(r["char_distance"], 6),
            round(r["word_distance"], 6), r["natural"]) for r in out.collect()]
    assert sorted(got) == sorted(want)
    assert judge(df.limit(0)).count() == 0


def test_hosts_urls_and_rules(spark):
    from spanweave.llm.catalog import URL_RULES
    from spanweave.llm.hosts import judge_urls
    urls = ["http://a.example.net/en/1", "http://example.net/de/1", "http://net", "http://net/", "HTTPS://B.Example.COM/de/x?y#z", "http://example.com/defer", None,
            "no scheme", "x://h?q", "http://notexample.com/de/", "ftp://u.org/fr/://x", "http://org/fr", "http://org/fr/", "http://a.b/é\n/c#d"]
    want = [("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/de/1", "net/", "block"), ("net", "", None, "allow"), ("net", "/", "net/", "block"),
            ("b.example.com", "/de/x", "example.com/de/", "block"), ("example.com", "/defer", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
            ("h", "", None, "allow"), ("notexample.com", "/de/", None, "allow"), ("u.org", "/fr/://x", "org/fr/", "allow"), ("org", "/fr", None, "allow"),
            ("org", "/fr/", "org/fr/", "allow"), ("a.b", "/é\n/c", None, "allow")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    none = spark.createDataFrame([], "page_id bigint, bad int")
    got = [tuple(r)[1:] for r in judge_urls(pages, none, URL_RULES).select("page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()]
    assert got == want
    assert judge_urls(pages.limit(0), none, []).count() == 0


def test_bad_hosts_are_blocked_and_thin_ones_shrink(spark):
    from spanweave.llm.hosts import judge_urls
    rows, bad = [], []
    for host, n, share in (("spam.a.com", 200, 0.9), ("ok.a.com", 200, 0.05), ("good.b.com", 300, 0.02), ("thin.b.com", 1, 1.0), ("new.b.com", 0, 0)):
        for j in range(max(n, 1)):
            rows.append((len(rows), f"http://{host}/{j}"))
            if n:
                bad.append((rows[-1][0], int(j < share * n)))
    pages = spark.createDataFrame([*rows, (None, "http://ok.a.com/"), rows[0]], "page_id bigint, url string")
    out = judge_urls(pages, spark.createDataFrame([*bad, (None, 1), (1, None)], "page_id bigint, bad int"), [])
    got = {r["host"]: r["verdict"] for r in out.select("host", "verdict").distinct().collect()}
    assert got == {"spam.a.com": "block", "ok.a.com": "allow", "good.b.com": "allow", "thin.b.com": "allow", "new.b.com": "allow"}


def test_own_pages_are_no_prior(spark):
    from spanweave.llm.hosts import PUBLIC_SUFFIXES, domain_of, judge_urls, suffix_of
    rows, bad = [], []

    def put(host, n, x):
        for j in range(n):
            rows.append((len(rows), f"http://{host}/{j}", "p", "r", "v", 0.5))
            bad.append((rows[-1][0], int(j < x)))

    for i in range(300):
        put(f"h{i}.dom{i % 60}.com", 6, 0 if i % 9 else 5)
    put("one.zzy", 1, 1)  # alone in its domain and suffix
    put("lone.lonely.com", 2, 2)  # alone in its domain
    put("first.ten.com", 2, 2)
    for j in range(10):
        put(f"s{j}.ten.com", 3, 0)
    put("worst.com", 200, 190)
    pages = spark.createDataFrame(rows, "page_id bigint, url string, path string, rule string, verdict string, bad_bound double")
    out = judge_urls(pages, spark.createDataFrame(bad, "page_id bigint, bad int"), [])
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict", "bad_bound"]
    got = {r["host"]: (r["verdict"], r["bad_bound"]) for r in out.select("host", "verdict", "bad_bound").distinct().collect()}
    assert got["one.zzy"][0] == "allow" and got["worst.com"][0] == "block"
    assert got["first.ten.com"][1] < got["lone.lonely.com"][1]  # clean siblings speak for a host
    only = judge_urls(pages.where("url like '%one.zzy%'"), spark.createDataFrame([(rows[-1][0], 1)] + bad, "page_id bigint, bad int"), [])
    assert [r["verdict"] for r in only.collect()] == ["allow"]
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "xco.uk", "b.xco.uk", "x.com", "com", "", "1.2.3.4", "u@x.org:80", "a..b"]
    cut = spark.createDataFrame([(h,) for h in hosts], "h string").select(domain_of(F.col("h")), suffix_of(F.col("h"))).collect()
    assert "co.uk" in PUBLIC_SUFFIXES
    assert [tuple(r) for r in cut] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("xco.uk", "uk"), ("xco.uk", "uk"), ("x.com", "com"),
                                       ("com", "com"), ("", ""), ("3.4", "4"), ("x.org:80".replace("x", "u@x"), "org:80"), (".b", "b")]


def test_a_pair_without_marginal_effect_is_learnt(spark):
    from spanweave.llm.toxicity import score, term_slots, train
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(4000):  # toxic when exactly one of the two stands there
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = [f"w{rng.randrange(400)}" for _ in range(8)] + ["alpha"] * a + ["Beta!"] * b
        rng.shuffle(text)
        rows.append((i, " ".join(text), 0.5, 7))
        labels.append((i, int(a != b)))
    docs = spark.createDataFrame([*rows, *rows[:50]], "doc_id bigint, text string, score double, predicted int")
    machine = train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), F.col("doc_id") % 4 != 2)
    out = score(docs, machine)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    got = out.collect()
    assert len(got) == 4050
    held = [(r["predicted"], dict(labels)[r["doc_id"]]) for r in got if r["doc_id"] % 4 == 2]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    for r in got[:40]:  # the score by definition
        slots = {int(term_slots(pa.array([w]), machine.hash_bits)[0][0]) for w in re.findall(r"[^\W_]+", r["text"])}
        f = [int(machine.feature[s]) for s in slots if machine.feature[s] >= 0]
        z = machine.bias + sum(machine.weight[a] for a in f) + sum(float(machine.vector[a] @ machine.vector[b]) for k, a in enumerate(f) for b in f[:k])
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    assert score(docs.limit(0), machine).collect() == []


def test_wrong_language_and_no_common_words_are_not_natural(spark):
    from spanweave.llm.quality import judge
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 4 = 0").select("doc_id", "text", "lang")
    rng = random.Random(4)
    salad = [(-1 - i, " ".join("".join(rng.choice("aeinorstlu") for _ in range(rng.randrange(6, 10))) for _ in range(n)) + ".", "en") for i, n in enumerate((120, 400, 3000))]
    text = {}
    for r in docs.where("length(text) between 2500 and 6000 and doc_id % 3 = 0").orderBy("doc_id").collect():
        text.setdefault(r["lang"], []).append(r["text"])
    wrong = [(-1000 - 100 * i - j, t, other) for i, (x, other) in enumerate((("en", "de"), ("de", "en"), ("de", "fr"), ("en", "es"), ("fr", "de"))) for j, t in enumerate(text[x][:5])]
    out = judge(docs.unionByName(spark.createDataFrame(salad + wrong, "doc_id bigint, text string, lang string")), columns=["doc_id", "lang"]).cache()
    got = {r["doc_id"]: r["natural"] for r in out.where("doc_id < 0").collect()}
    assert not any(got[i] for i, _, _ in salad)
    assert sum(not got[i] for i, _, _ in wrong) >= 0.95 * len(wrong)
    clean = out.where("doc_id >= 0 and n_words >= 100").groupBy("lang").agg(F.avg(F.col("natural").cast("int")).alias("share")).collect()
    assert len(clean) == 4 and all(r["share"] > 0.8 for r in clean)


def test_repeated_windows_compare_whole_hashes(spark):
    from spanweave.llm.quality import repeated_windows
    high = 1 << 62  # differs in a high bit alone
    rows = [([7, 7, 1, 2, 1 | high, 3, 4, -5, 6],), ([1, 2, 3],), ([9, 8, 9, 8 | high, 5, 9],), ([],)]
    df = spark.createDataFrame(rows, "h array<bigint>")
    assert [r[0] for r in df.select(repeated_windows(F.col("h"))).collect()] == [4, 0, 8, 0]


def test_common_words_are_counted_whatever_their_length(spark, tmp_path):
    from spanweave.llm.catalog import LLM_QUERIES
    rng = random.Random(9)
    own = ["zusammenhang", "entsprechend", "wissenschaft", "of", "a"]  # the commonest words are long ones
    texts = [" ".join(rng.choices(own + ["und", "in"], [9, 8, 7, 1, 1, 1, 1], k=300)) for _ in range(30)]
    texts.append(" ".join(rng.choices(["of", "a", "und", "in"] + [f"anderes{i}" for i in range(300)], [9, 9, 9, 9] + [1] * 300, k=300)))
    df = spark.createDataFrame([(i, "de", t) for i, t in enumerate(texts)], "doc_id bigint, lang string, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in LLM_QUERIES["op9_quality_rules"](spark, str(tmp_path)).collect()}
    words = [t.split() for t in texts]
    top = sorted(Counter(w for x in words for w in x).items(), key=lambda a: (-a[1], a[0].encode()))[:24]
    total = sum(map(len, words))

    def distance(p, q):
        p, q = [*p, 1 - sum(p)], [*q, 1 - sum(q)]
        part = lambda a, b: a * math.log(2 * a / (a + b)) if a > 0 else 0.0
        return math.sqrt(max(sum(part(a, b) + part(b, a) for a, b in zip(p, q)), 0) / (2 * math.log(2)))
    for i, w in enumerate(words):
        assert got[i]["word_distance"] == pytest.approx(distance([w.count(a) / len(w) for a, _ in top], [n / total for _, n in top]), abs=2e-6)
    assert got[30]["word_distance"] > 0.6 > max(got[i]["word_distance"] for i in range(30))
