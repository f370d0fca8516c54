import re
import zlib
from collections import Counter, defaultdict
from math import exp, log, sqrt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import ann, labels, packing, quality_crf, quality_rules, toxicity, url_filter
from tessella.llm import sentencepiece_nbest as sp

SCHEMA = "doc_id long, text string, lang string"
ODD = [None, "", " ", "\n", "a", "a\n\nb  c", "é" * 3000, "x" * 5000, "word " * 4000, "日本 語 <|endoftext|> テスト", " " * 900 + "y", "ok\x00\x1c z", "▁ own mark ▁"]


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


# --- packing


def check_packed(rows, want, tiers=packing.TIERS):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for doc, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[doc]) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(want[doc][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want[doc])
    padded = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= max(tiers)
        padded += at not in tiers
    return padded


def test_packing_by_the_tokenizer_itself(spark, tokenizer):
    texts = [*ODD, *(" ".join(f"token{k}{j}" for j in range(k * 7)) for k in range(60))]
    rows = packing.packed_digest(docs(spark, texts)).collect()
    want = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for k, t in enumerate(texts)}
    assert check_packed(rows, want) <= 3  # one sequence of each partition at most is to be padded


def test_packing_a_whole_table(spark, sf, tokenizer):
    want = {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [0] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check_packed(packing.op1_packing(spark, sf).collect(), want) <= 1


def test_packing_edges(spark):
    assert packing.packed_digest(docs(spark, [])).count() == 0
    df = docs(spark, ["a b", "a b"]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("offset", F.lit(1)).withColumn("tier", F.lit("x"))
    rows = packing.packed_digest(df).collect()
    assert len(rows) == 2 and {r.doc_id for r in rows} == {None}


def test_packer_fills_windows_from_shorter_tiers():
    packer = packing.Packer((8, 16, 32), pool=1000)
    done = []
    for k, n in enumerate([20, 7, 3, 2, 30, 40, 1, 16, 9]):
        done += packer.add(k, np.arange(n, dtype="<u4").tobytes())
    done += packer.close()
    sizes = [sum(len(p[2]) // 4 for p in own) for _, own in done]
    assert sum(sizes) == 128 and all(s in (8, 16, 32) for s in sizes)


def test_step_groups_are_balanced():
    rng = np.random.default_rng(1)
    sequences = [(t, [(0, 0, bytes(4 * int(t)), t)]) for t in rng.choice([128, 256, 512, 1024], 400)]
    group = packing.step_groups(sequences, 16_384)
    tokens, cost = Counter(), Counter()
    for (t, _), g in zip(sequences, group, strict=True):
        tokens[g] += int(t)
        cost[g] += int(t) ** 2
    assert max(tokens.values()) <= 16_384 + 1024 and max(cost.values()) < 1.5 * np.mean(list(cost.values()))


# --- pieces


def every_way(unit, v):
    if not unit:
        yield 0, ()
        return
    for i in range(1, len(unit) + 1):
        head = unit[:i]
        if i == 1:
            ids, s = v.char(head)
        elif head in v.pieces:
            ids, s = (v.pieces[head][0],), v.pieces[head][1]
        else:
            continue
        for t, rest in every_way(unit[i:], v):
            yield s + t, ids + rest


@pytest.mark.parametrize("text", ["", "hello", "a b", "the cat", "x  y", "é▁ b", "日本 語", " ", "a ", "ththth in"])
def test_n_best_by_all_segmentations(text):
    s = sp._segmenter(None)
    got = s.n_best(text, 5)
    unit = ("▁" + text.replace("▁", sp.OWN_MARK).replace(" ", "▁")) if text else ""
    want = sorted(every_way(unit, s.v), key=lambda x: -x[0])
    assert [g[0] for g in got] == [w[0] for w in want[:5]] and len({g[1] for g in got}) == len(got)
    for score, ids in got:
        assert (score, tuple(np.frombuffer(ids, "<u4").tolist())) in want and s.decode(ids) == text


def test_units_one_by_one_and_in_order():
    rng = np.random.default_rng(2)
    units = {"".join(rng.choice(list("theanoriéx日"), int(rng.integers(0, 9)))) for _ in range(200)} | {"x" * 100}
    s = sp.Segmenter(sp._segmenter(None).v)
    for u, (score, ids, gap) in s.learn(set(units)).items():
        if len(u) < 12:
            want = sorted(every_way("▁" + u, s.v), key=lambda x: -x[0])
            assert score == want[0][0] and gap == (score - want[1][0] if len(want) > 1 else sp.NEVER)
            assert [x[0] for x in s.n_best_unit("▁" + u, 4)] == [w[0] for w in want[:4]]
        assert s.decode(ids) == u


def test_pieces_round_trip_in_spark(spark):
    out = sp.encode_n_best(docs(spark, ODD).withColumn("rank", F.lit(7)), n=2)
    rows = out.select("doc_id", "rank", "n_pieces", sp.decode_column(F.col("ids")).alias("text")).collect()
    assert all(r.text == (ODD[r.doc_id] or "") for r in rows) and {r["rank"] for r in rows} == {1, 2}
    assert {r.doc_id for r in rows} == set(range(len(ODD))) and sp.encode_n_best(docs(spark, [])).count() == 0


def test_op2_over_a_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sp.op2_sentencepiece(spark, sf).collect()
    assert len(rows) == 3 * len(texts) and all(r.decoded_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def plain_best_scores(text, v, n):
    """The ``n`` best scores of a whole text, each position keeping its own ``n`` best."""
    line = ("▁" + text.replace("▁", sp.OWN_MARK).replace(" ", "▁")) if text else ""
    best = [[0]] + [[] for _ in line]
    for j in range(len(line)):
        best[j] = sorted(best[j], reverse=True)[:n]
        for i in range(j + 1, len(line) + 1):
            head = line[j:i]
            if i > j + 1 and head not in v.heads:
                break
            s = v.char(head)[1] if i == j + 1 else v.pieces[head][1] if head in v.pieces else None
            if s is not None:
                best[i] += [b + s for b in best[j]]
            if i == j + 1 and head not in v.heads:
                break
    return sorted(best[-1], reverse=True)[:n]


def test_op2_ranks_are_the_best_of_whole_texts(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = defaultdict(dict)
    for r in sp.op2_sentencepiece(spark, sf).collect():
        got[r.doc_id][r["rank"]] = round(r.score * sp.SCALE)
    v = sp._segmenter(None).v
    for doc, text in texts.items():
        assert [got[doc][k] for k in sorted(got[doc])] == plain_best_scores(text, v, 3), doc


# --- urls


def test_hosts_paths_and_rules(spark):
    urls = [None, "nothing", "://", "http://A.NET/x?y", "http://a.net", "https://www.example.net/en/1", "https://example.net/de/1", "http://x.example.com/de/?q", "http://notexample.com/de/", "http://m.org/fr/a#b", "http://org/fr/", "http://b.org/fr", "http://é😀.net/é#x", "http://a.net/" + "p" * 50_000]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    rows = {r.page_id: r for r in url_filter.url_verdicts(df).collect()}
    assert [(rows[k].host, rows[k].path) for k in range(len(urls))] == [url_filter.host_and_path(u) for u in urls]
    assert [rows[k].rule for k in range(len(urls))] == [None, None, None, "net/", None, "example.net/en/", "net/", "example.com/de/", None, "org/fr/", "org/fr/", None, "net/", "net/"]
    assert [rows[k].verdict for k in (3, 5, 6, 7, 9)] == ["block", "allow", "block", "block", "allow"]
    weight, bias = url_filter._model()
    for k in (0, 4, 8, 11):
        own = url_filter.grams(rows[k].host, rows[k].path)
        assert rows[k].verdict == ("block" if (sum(weight[g] + bias for g in own) if own else bias) >= 0 else "allow")
    assert url_filter.url_verdicts(df.limit(0)).count() == 0


def test_regression_learns_held_out_hosts():
    rows = url_filter.labelled_urls()
    hosts = sorted({url_filter.host_and_path(u)[0].removeprefix("www.").removeprefix("m.") for u, _ in rows})
    out = {h for k, h in enumerate(hosts) if k % 4 == 0}
    held = lambda u: url_filter.host_and_path(u)[0].removeprefix("www.").removeprefix("m.") in out
    weight, bias = url_filter.train([r for r in rows if not held(r[0])])
    hits = []
    for u, y in rows:
        if held(u):
            own = url_filter.grams(*url_filter.host_and_path(u))
            # The labelled table has as many of both kinds, so the share among pages is taken out again.
            hits.append((sum(weight[g] for g in own) / len(own) + bias >= url_filter.SCALE * -2.2) == bool(y))
    assert np.mean(hits) > 0.7
    with pytest.raises(ValueError, match="at most"):
        url_filter.train([("a", 0)] * (url_filter.MAX_LABELLED + 1))


def test_url_sql(spark, sf, duck, same_rows):
    assert same_rows(url_filter.op4_url_filter(spark, sf).toPandas(), duck(url_filter.op4_sql()))


# --- rules


def brute_base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(covered)


def test_rule_features_by_brute_force(spark, sf):
    texts = [*ODD, "a b c d e " * 3, "a b c d e a b c d e f", "x\nx\n\nx \ny\ny", "# $ % & | < > *", "a a a a a a a", *(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect())]
    df = docs(spark, texts).withColumn("votes", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("words", F.lit(1))
    rows = quality_rules.text_features(df, "doc_id", "text").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(texts[r.doc_id]), texts[r.doc_id]


def plain_votes(rows, rounds=1000):
    """Expectation-maximisation document by document."""
    n = len(rows[0])
    good = [0.5 if -1 in r else 0.9 for r in rows]
    for _ in range(rounds):
        share = (1 + sum(good)) / (2 + len(rows))
        rate = {}
        for j in range(n):
            for c in (0, 1):
                w = [(g if c else 1 - g, r[j]) for g, r in zip(good, rows, strict=True)]
                rate[j, c] = (1 + sum(x for x, v in w if v < 0)) / (2 + sum(x for x, v in w if v))
        new = []
        for r in rows:
            like = {c: (share if c else 1 - share) for c in (0, 1)}
            for j, v in enumerate(r):
                for c in (0, 1):
                    like[c] *= rate[j, c] if v < 0 else 1 - rate[j, c] if v else 1.0
            new.append(like[1] / (like[0] + like[1]))
        if max(abs(a - b) for a, b in zip(new, good, strict=True)) < 1e-10:
            break
        good = new
    return new


def test_votes_by_a_plain_account():
    rng = np.random.default_rng(8)
    rows = [tuple(int(v) for v in r) for r in rng.choice([-1, 0, 1, 1, 1], (150, 4))]
    model = quality_rules.fit_votes(dict(Counter(rows)))
    assert [model.posterior(r) for r in rows] == pytest.approx(plain_votes(rows), abs=1e-6)


def test_votes_recover_planted_accuracies():
    """Rates in both classes are free: four rules are right about bad documents, the fifth votes bad at random."""
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.8
    bad_rate = np.where(good[:, None], [0.01, 0.02, 0.01, 0.03, 0.1], [0.7, 0.6, 0.8, 0.5, 0.1])
    votes = np.where(rng.random((20_000, 5)) < 0.2, 0, np.where(rng.random((20_000, 5)) < bad_rate, -1, 1))
    model = quality_rules.fit_votes(dict(Counter(map(tuple, votes.tolist()))))
    assert abs(model.prior - 0.8) < 0.02
    assert model.on_good == pytest.approx([0.01, 0.02, 0.01, 0.03, 0.1], abs=0.02) and model.on_bad == pytest.approx([0.7, 0.6, 0.8, 0.5, 0.1], abs=0.05)
    hit = np.array([model.posterior(tuple(v)) >= 0.5 for v in votes.tolist()]) == good
    true = quality_rules.VoteModel(0.8, [0.01, 0.02, 0.01, 0.03, 0.1], [0.7, 0.6, 0.8, 0.5, 0.1])
    best = np.array([true.posterior(tuple(v)) >= 0.5 for v in votes.tolist()]) == good
    assert hit.mean() > best.mean() - 0.005  # as good as with the rates known
    assert model.posterior((1, 1, 1, 1, -1)) > 0.95  # a single vote of the random rule is overruled,
    assert model.posterior((1, 1, 1, -1, 1)) > 0.5  # and so is one of the weakest of the others;
    assert model.posterior((0, -1, 0, -1, 1)) < 0.05 and model.posterior((1, -1, 0, -1, 1)) < 0.5  # two weak ones condemn


def test_op6_verdicts_are_those_of_the_method(spark, sf):
    """Every row's kept from the votes by the plain account; some single bad votes are overruled."""
    rows = quality_rules.op6_quality_rules(spark, sf.replace("sf0.001", "sf0.01")).collect()
    votes = [tuple(int(c) - 1 for c in r.votes) for r in rows]
    for r, p in zip(rows, plain_votes(votes), strict=True):
        assert r.good_probability == pytest.approx(p, abs=1e-5) and r.kept == (not r.base_failed and p >= 0.5)
    assert any(r.kept for r, v in zip(rows, votes, strict=True) if -1 in v)
    with pytest.raises(ValueError, match="feature"):
        quality_rules.quality_votes(docs(spark, ["a"]).withColumnRenamed("doc_id", "n_words"), id_col="n_words")


def test_op6_keeps_good_documents(spark, sf):
    rows = quality_rules.op6_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows) and not any(r.kept and r.base_failed for r in rows)
    good = [r for r in rows if r.quality and not r.base_failed]
    assert np.mean([r.kept for r in good]) > 0.95
    assert quality_rules.quality_votes(docs(spark, [])).count() == 0


# --- classifiers


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / n1 / (len(y) - n1)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(5)
    crf = quality_crf.Crf(np.zeros(1), rng.normal(size=(2, 2)))
    odds = rng.normal(size=6)
    weight = {}
    for k in range(64):
        y = [k >> j & 1 for j in range(6)]
        weight[tuple(y)] = exp(sum(o for o, s in zip(odds, y, strict=True) if s) + sum(crf.step[a, b] for a, b in zip(y, y[1:], strict=False)))
    total = sum(weight.values())
    good, moves, log_z = crf.marginals(odds)
    assert log_z == pytest.approx(log(total))
    assert good == pytest.approx([sum(w for y, w in weight.items() if y[j]) / total for j in range(6)])
    assert moves[1, 0] == pytest.approx(sum(w * sum(a == 1 and b == 0 for a, b in zip(y, y[1:], strict=False)) for y, w in weight.items()) / total)


def test_quality_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    rows = quality_crf.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert auc(np.array([r.score for r in rows]), np.array([r.quality for r in rows])) > 0.95


def test_op5_over_a_whole_table(spark, sf):
    """Every score from the marginals of a forward-backward pass in logarithms, state by state."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality_crf.fit_quality(labels.labelled_sample(table, spark.read.parquet(f"{sf}/labels.parquet"), "quality"))
    texts = {r.doc_id: r.text for r in table.collect()}
    step = model.crf.step
    for r in quality_crf.op5_quality(spark, sf).collect():
        rows, size = quality_crf.text_features(texts[r.doc_id])
        odds = np.clip(rows @ model.crf.emit, -30, 30)
        ahead, back = [np.array([0.0, odds[0]])], [np.zeros(2)]
        for o in odds[1:]:
            ahead.append(np.array([np.logaddexp(*(ahead[-1] + step[:, s])) + (o if s else 0.0) for s in (0, 1)]))
        for o in odds[:0:-1]:
            back.append(np.array([np.logaddexp(*(step[s] + back[-1] + np.array([0.0, o]))) for s in (0, 1)]))
        both = np.array(ahead) + np.array(back[::-1])
        good = np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))
        mean = min(1 - 1e-4, max(1e-4, float((good * size).sum() / size.sum())))
        a, b = model.curve
        assert r.score == pytest.approx(1 / (1 + exp(-(a + b * log(mean / (1 - mean))))), abs=1e-6)
        assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_toxicity_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    rows = toxicity.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert auc(np.array([r.score for r in rows]), np.array([r.toxic for r in rows])) > 0.93
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95


def test_scores_of_odd_texts(spark):
    table = docs(spark, [*ODD, *["good words in a calm line here"] * 40, *["## $$ %% BAD!! ##"] * 40]).withColumn("score", F.lit("x")).withColumn("evidence", F.lit(1))
    marks = spark.createDataFrame([(k, int(k < len(ODD) + 40), int(k >= len(ODD) + 40)) for k in range(len(ODD), len(ODD) + 80)] + [(None, 1, 1), (3, None, None), (900, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality_crf.fit_quality(labels.labelled_sample(table, marks, "quality"))
    out = quality_crf.quality_scores(table, model).collect()
    assert len(out) == len(ODD) + 80 and all(0 <= r.score <= 1 for r in out)
    assert min(r.score for r in out if "calm" in (r.text or "")) > max(r.score for r in out if "BAD" in (r.text or ""))
    tox = toxicity.fit_toxicity(labels.labelled_sample(table, marks, "toxic"))
    got = toxicity.toxicity_scores(table, tox).collect()
    assert all(0 <= r.score <= 1 for r in got) and all(r.score > 0.5 for r in got if "BAD" in (r.text or ""))
    assert not labels.labelled_sample(table, marks.limit(0), "toxic").texts
    for m in (quality_crf.fit_quality(labels.labelled_sample(table, marks.limit(0), "quality")), ):
        assert quality_crf.quality_scores(table.limit(0), m).count() == 0
    none = toxicity.fit_toxicity(labels.labelled_sample(table, marks.limit(0), "toxic"))
    assert toxicity.toxicity_scores(table, none).filter("score <> 0").count() == 0
    clash = table.withColumn("judged", F.lit(5)).withColumn("__tox", F.lit(6)).withColumn("a.b", F.lit(7))
    assert [tuple(r) for r in toxicity.toxicity_scores(clash, tox).select("judged", "__tox", "`a.b`").distinct().collect()] == [(5, 6, 7)]


def test_nearest_examples_by_brute_force():
    rng = np.random.default_rng(7)
    n_terms, vectors = 60, []
    for _ in range(300):
        terms = np.sort(rng.choice(n_terms, int(rng.integers(0, 12)), replace=False))
        vectors.append((terms, rng.random(len(terms)).round(2)))
    vectors[200:210] = [vectors[199]] * 10  # equal examples
    dense = np.zeros((300, n_terms))
    for d, (t, w) in enumerate(vectors):
        dense[d, t] = w
    index = toxicity.BlockMaxIndex(vectors, n_terms)
    for t, w in vectors[:80] + vectors[199:203]:
        for k in (1, 7, 400):
            score = dense[:, t] @ w if len(t) else np.zeros(300)
            want = [d for d in np.lexsort((np.arange(300), -score.round(10))) if score[d] > 0][:k]
            got = index.nearest(t.astype(np.int64), w, k)
            assert sorted(round(c, 9) for c, _ in got) == sorted(score[want].round(9).tolist()) and len({d for _, d in got}) == len(want)
            if want:  # but for ties within rounding at the edge, the same ones
                assert {d for c, d in got if c > score[want[-1]] + 1e-9} == {d for d in want if score[d] > score[want[-1]] + 1e-9}
            assert all(c == pytest.approx(score[d], abs=1e-9) for c, d in got)
    assert index.nearest(np.empty(0, np.int64), np.empty(0), 3) == []


def test_op8_over_a_whole_table(spark, sf):
    """All rows' neighbours are those of brute force over vectors made from the words, every word of the sample in them."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    sample = labels.labelled_sample(table, spark.read.parquet(f"{sf}/labels.parquet"), "toxic")
    found = [Counter(re.findall(r"\w+", t.lower())) for t in sample.texts]
    vocab = {w: k for k, w in enumerate(sorted({w for c in found for w in c}))}
    y = np.array(sample.labels)
    present = np.zeros((len(found), len(vocab)))
    for k, c in enumerate(found):
        present[k, [vocab[w] for w in c]] = 1
    a, b, n1, n0 = present[y == 1].sum(0), present[y == 0].sum(0), (y == 1).sum(), (y == 0).sum()
    p = (a + b + 1) / (len(y) + 2)
    weight = (np.log((1 + len(y)) / (1 + a + b)) + 1) * ((a + 0.5) / (n1 + 1) - (b + 0.5) / (n0 + 1)) ** 2 / (p * (1 - p))

    def unit(counts):
        v = np.zeros(len(vocab))
        for w, n in counts.items():
            if w in vocab:
                v[vocab[w]] = (1 + log(n)) * weight[vocab[w]]
        return v / (sqrt(v @ v) or 1.0)

    examples, ids = np.array([unit(c) for c in found]), {str(i): k for k, i in enumerate(sample.ids)}
    share = sample.weights()
    votes = np.array([share[v] for v in sample.labels]) / min(share[v] for v in sample.labels)
    base = sample.total[1] / (sample.total[0] + sample.total[1])
    texts = {r.doc_id: r.text for r in table.collect()}
    share_of = lambda at, cosine: (toxicity.PRIOR_WEIGHT * base + (cosine * votes[at] * y[at]).sum()) / (toxicity.PRIOR_WEIGHT + (cosine * votes[at]).sum())
    alone, told = [], []
    for k in range(len(examples)):  # every example by the others
        cosine = examples @ examples[k]
        cosine[k] = -1
        at = np.lexsort((np.arange(len(y)), -cosine.round(12)))[: toxicity.NEAREST]
        at = at[cosine[at] > 0]
        if len(at):
            alone.append(share_of(at, cosine[at]))
            told.append(k)
    slope, offset = toxicity.fit_curve(np.array(alone), y[told], votes[told])
    curve = lambda p: 1 / (1 + (p / (1 - p)) ** -slope * np.exp(-offset))
    rows = toxicity.op8_toxicity(spark, sf).collect()
    assert len(rows) == table.count()
    for r in rows:
        cosine = examples @ unit(Counter(re.findall(r"\w+", (texts[r.doc_id] or "").lower())))
        best = np.sort(cosine[cosine > 0])[::-1][: toxicity.NEAREST]
        assert [e.cosine for e in r.evidence] == pytest.approx(best.tolist(), abs=1e-9)
        assert all(e.cosine == pytest.approx(cosine[ids[e.example]], abs=1e-9) for e in r.evidence)
        at = [ids[e.example] for e in r.evidence]
        share = share_of(at, np.array([e.cosine for e in r.evidence]))
        assert r.score == pytest.approx(curve(np.clip(share, toxicity.EDGE, 1 - toxicity.EDGE)) if at else base, abs=2e-3)


def test_the_curve_is_of_largest_likelihood():
    rng = np.random.default_rng(3)
    share = rng.random(4000)
    labels = (rng.random(4000) < toxicity.calibrated(share, (0.6, -1.0))).astype(float)
    weights = np.where(labels > 0, 1.0, 3.0)
    a, b = toxicity.fit_curve(share, labels, weights)

    def loss(a, b):
        p = toxicity.calibrated(share, (a, b))
        w = weights / weights.mean()
        return -(w * np.log(np.where(labels > 0, p, 1 - p))).sum() + toxicity.RIDGE / 2 * ((a - 1) ** 2 + b * b)

    assert all(loss(a, b) <= loss(a + x, b + z) for x, z in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)))
    flat = toxicity.fit_curve(share, labels, np.ones(4000))
    assert flat == pytest.approx((0.6, -1.0), abs=0.15)  # with even weights the curve that made the labels
    assert toxicity.fit_curve(np.array([0.9, 0.1]), np.array([0.0, 1.0]), np.ones(2)) == (1.0, 0.0)  # never turned round


def test_toxicity_is_calibrated_on_held_out_rows(spark, sf):
    """Brier score and reliability on rows whose labels are never learnt."""
    sf = sf.replace("sf0.001", "sf0.1")
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").collect()}
    rows = [(r.score, known[r.doc_id]) for r in toxicity.op8_toxicity(spark, sf).filter("held_out").select("doc_id", "score").collect() if r.doc_id in known]
    score, label = np.array(rows).T
    share = label.mean()
    assert len(rows) > 200 and ((score >= 0.5) == label).mean() > 0.97
    assert ((score - label) ** 2).mean() < 0.25 * share * (1 - share)  # Brier: a quarter of that of the share alone
    bands = [(score >= a) & (score < b) for a, b in ((0, 0.1), (0.1, 0.5), (0.5, 0.9), (0.9, 1.01))]
    off = sum(abs(score[m].mean() - label[m].mean()) * m.mean() for m in bands if m.any())
    assert off < 0.03  # expected calibration error


# --- neighbours


def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1200, 24)).astype(np.float32)
    x[100:130] = x[99]  # a group of equal vectors
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] * 24), (2004, [1.0]), (2005, [float("inf")] * 24), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit(1)).repartition(4)
    got = defaultdict(dict)
    for r in ann.nearest_neighbours(df, df.filter("vec_id % 50 = 0"), part_rows=100).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    dealt = ann.nearest_neighbours(df, df.filter("vec_id % 50 = 0"), part_rows=7, query_rows=3)
    assert {(r.query_id, r["rank"]): r.score for r in dealt.collect()}.keys() == {(q, k) for q, own in got.items() for k in own}
    assert set(got) == set(range(0, 1200, 50))
    d = x.astype(float)
    unit = d / np.sqrt((d * d).sum(1))[:, None]
    hits = 0
    for q, own in got.items():
        s = unit @ unit[q]
        s[q] = -9
        want = np.lexsort((np.arange(1200), -s.round(12)))[:5].tolist()
        assert sorted(own) == [1, 2, 3, 4, 5]
        assert all(own[r][1] == pytest.approx(s[own[r][0]], abs=1e-12) for r in own)
        hits += len({v for v, _ in own.values()} & set(want))
        if q == 100:
            assert [own[r][0] for r in range(1, 6)] == [99, 101, 102, 103, 104]
    assert hits / (5 * len(got)) > 0.9
    few = spark.createDataFrame(rows[:3] + rows[1200:], "vec_id long, embedding array<float>")
    assert ann.nearest_neighbours(few, few).count() == 6
    assert ann.nearest_neighbours(df.limit(0), df).count() == 0


def test_every_query_has_its_results(spark):
    """Outliers alone in their lists, clusters of two, and more neighbours asked for than a list has."""
    rng = np.random.default_rng(7)
    hubs = rng.normal(size=(20, 16))
    x = np.concatenate([hubs[np.arange(400) % 20] + 0.01 * rng.normal(size=(400, 16)), 30 * rng.normal(size=(2, 16)), np.repeat(30 * rng.normal(size=(3, 16)), 2, 0) + 0.01 * rng.normal(size=(6, 16))])
    ids = [*range(400), 1000, 2000, *range(3000, 3300, 50)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(4)
    asked = df.filter("vec_id % 50 = 0")
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    for k, probes in ((5, 1), (40, 1), (5, None)):
        got = defaultdict(dict)
        for r in ann.nearest_neighbours(df, asked, k=k, lists=24, probes=probes).collect():
            got[r.query_id][r["rank"]] = (r.vec_id, r.score)
        assert set(got) == {i for i in ids if i % 50 == 0} and all(sorted(own) == list(range(1, k + 1)) for own in got.values())
        for q in (1000, 2000):  # few in the lists probed: searched in all
            s = unit @ unit[ids.index(q)]
            s[ids.index(q)] = -9
            assert [own[0] for own in (got[q][r] for r in range(1, 4))] == [ids[j] for j in np.argsort(-s)[:3]]
    all_ = ann.nearest_neighbours(df, asked, k=1000, lists=24, probes=2).groupBy("query_id").count().collect()
    assert {r["count"] for r in all_} == {len(ids) - 1}


def test_near_copies_beyond_the_shortlist():
    """Of 3,000 near copies with equal codes, the nearest have the largest ids; part of a list of 8,000 rows."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=24)
    copies = base + 1e-9 * rng.normal(size=(3000, 24))
    x = np.concatenate([rng.normal(size=(5000, 24)), copies])
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    q = ann.fit_quantizer(unit[:5001], lists=1)
    codes = q.codes(unit, np.zeros(len(x), int))
    assert len(np.unique(codes[5000:], axis=0)) < 20
    index = pa.table({"id": np.arange(len(x)), "list": np.zeros(len(x), np.int32), "codes": [c.tobytes() for c in codes], "vector": x.tolist()})
    asked = [*(copies[-4:] + 1e-8 * base), *(copies[-4:])]
    queries = pa.table({"query": [100_000 + k for k in range(8)], "vector": [v.tolist() for v in asked]})
    got = defaultdict(list)
    for r in ann._search(q, 5, ann.RERANK)(index, queries).to_pylist():
        got[r["query_id"]].append(r["vec_id"])
    for k, v in enumerate(asked):
        score = ann.cosines(v, x)
        assert got[100_000 + k] == np.lexsort((np.arange(len(x)), -score))[:5].tolist()


def test_the_shortlist_keeps_all_ties():
    gap = np.array([1.0, 0.5, 1.0, np.inf, 1.0, 2.0, 1.0 + 1e-14])
    assert np.flatnonzero(ann._least(gap, 2)[0]).tolist() == [0, 1, 2, 4, 6]


def test_tables_give_the_distances_of_decoded_rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 22))
    x /= np.sqrt((x * x).sum(1))[:, None]
    q = ann.fit_quantizer(x, lists=5, subspaces=8)
    codes = q.codes(x[:50], np.full(50, 3))
    coded = np.concatenate([q.books[m][codes[:, m]] for m in range(8)], axis=1)[:, :22] + q.centers[3]
    assert q.distances(x[50:60], 3, codes) == pytest.approx(((x[50:60, None] - coded[None]) ** 2).sum(2), abs=1e-9)


def test_recall_with_lists_larger_than_the_shortlist(spark):
    """50,000 vectors in 224 lists of about three shortlists each."""
    rng = np.random.default_rng(12)
    n, dim = 50_000, 24
    hubs = rng.normal(size=(300, dim))
    x = (hubs[rng.integers(0, 300, n)] + 0.9 * rng.normal(size=(n, dim))).astype(np.float32)
    x[20_000:23_000] = x[20_000] + np.float32(1e-4) * rng.normal(size=(3000, dim)).astype(np.float32)  # near copies
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float32()))})).repartition(8)
    got = defaultdict(set)
    for r in ann.nearest_neighbours(df, df.filter("vec_id % 50 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    d = x.astype(float)
    unit = d / np.sqrt((d * d).sum(1))[:, None]
    hits = {True: [], False: []}
    for q in range(0, n, 50):
        s = unit @ unit[q]
        s[q] = -9
        hits[20_000 <= q < 23_000].append(len(got[q] & set(np.argpartition(-s, 5)[:5].tolist())) / 5)
    assert n / 224 > 3 * ann.RERANK and np.mean(hits[False]) >= 0.9 and np.mean(hits[True]) >= 0.9


@pytest.mark.parametrize("kind", ["far", "between", "one in ten far"])
def test_recall_of_queries_unlike_the_rows(spark, kind):
    """Rows in tight groups, and queries that lie elsewhere: lists and codes are chosen by what the queries need."""
    rng = np.random.default_rng(21)
    n, dim = 6000, 32
    hubs = rng.normal(size=(120, dim))
    x = hubs[rng.integers(0, 120, n)] + 0.05 * rng.normal(size=(n, dim))
    asked = np.arange(0, n, 50)
    far = asked[::10] if kind == "one in ten far" else asked
    x[far] = x[far] + x[rng.integers(0, n, len(far))] if kind == "between" else rng.normal(size=(len(far), dim))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float64()))})).repartition(4)
    got = defaultdict(set)
    for r in ann.nearest_neighbours(df, df.filter("vec_id % 50 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    hits = {}
    for q in asked.tolist():
        s = unit @ unit[q]
        s[q] = -9
        hits[q] = len(got[q] & set(np.argsort(-s)[:5].tolist())) / 5
    assert all(len(got[q]) == 5 for q in asked.tolist())
    assert np.mean(list(hits.values())) >= 0.9 and np.mean([hits[q] for q in far.tolist()]) >= (0.5 if kind == "one in ten far" else 0.9)


def test_codes_to_rerank_are_measured(spark):
    """All rows in one list, and all that tells them apart in the four components of one code byte: the shortlist has to grow."""
    rng = np.random.default_rng(22)
    n = 4000
    x = np.concatenate([rng.normal(size=(n, 4)), np.zeros((n, 60))], axis=1)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float64()))})).repartition(4)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    hits = 0
    got = defaultdict(set)
    for r in ann.nearest_neighbours(df, df.filter("vec_id % 50 = 0"), lists=1, rerank=5).collect():
        got[r.query_id].add(r.vec_id)
    for q in range(0, n, 50):
        s = unit @ unit[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits / (5 * len(got)) >= 0.93


def test_recall_on_the_embeddings(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    got = defaultdict(set)
    for r in ann.op7_ann(spark, sf).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q, own in got.items():
        s = unit @ unit[ids == q][0]
        s[ids == q] = -9
        hits += len(own & set(ids[np.argsort(-s)[:5]].tolist()))
    assert hits / (5 * len(got)) >= 0.9


def test_cosines_keep_large_and_small_vectors():
    assert ann.cosines(np.array([1e300, 1e300]), np.array([[1e-300, 0.0]]))[0] == pytest.approx(sqrt(0.5))


# --- names


ODD_NAMES = ["t", "words", "lines", "h", "w", "s", "p", "id", "text", "list", "__id", "a.b", "Doc Id"]


def test_ids_of_any_name(spark):
    """Names that operators use inside, and dotted ones, come back; names of results are refused."""
    rows = [(3, "One two three four five six seven.\nAnd a line that is fine."), (None, None), (5, "a " * 40)]
    for name in ODD_NAMES:
        df = spark.createDataFrame(rows, "i long, x string").select(F.col("i").alias(name), F.col("x").alias("the.text"))
        assert quality_rules.quality_votes(df, id_col=name, text_col="the.text").columns[0] == name
        packed = packing.pack_documents(df, packing.byte_bpe(), id_col=name, text_col="the.text")
        assert packed.columns[0] == name
        assert sp.encode_n_best(df, id_col=name, text_col="the.text").columns[0] == name
        assert url_filter.url_verdicts(df, id_col=name, url_col="the.text").columns[0] == name
    assert {r["Doc Id"] for r in packed.collect()} == {3, None, 5}
    assert quality_rules.quality_votes(df, id_col="Doc Id", text_col="the.text").count() == 3
    assert url_filter.url_verdicts(df, id_col="Doc Id", url_col="the.text").count() == 3
    for call, names in ((lambda n: quality_rules.quality_votes(df, id_col=n), ["n_words", "Votes"]), (lambda n: packing.pack_documents(df, packing.byte_bpe(), id_col=n), ["length", "TIER"]), (lambda n: sp.encode_n_best(df, id_col=n), ["rank", "score"]), (lambda n: url_filter.url_verdicts(df, id_col=n), ["host", "verdict"])):
        for n in names:
            with pytest.raises(ValueError, match="result"):
                call(n)


def test_labels_of_any_name(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(30)], "i long, x string").select(F.col("i").alias("a.id"), F.col("x").alias("a.text"))
    marks = spark.createDataFrame([(k, k % 2) for k in range(30)], "i long, y int").select(F.col("i").alias("a.id"), F.col("y").alias("a.y"))
    sample = labels.labelled_sample(docs, marks, "a.y", id_col="a.id", text_col="a.text")
    assert len(sample.texts) == sum(sample.total.values()) > 10 and all(t == f"text {i}" for t, i in zip(sample.texts, sample.ids, strict=True))
