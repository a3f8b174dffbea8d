"""Rules of single operators on tiny tables with literal expectations."""

import html
import json
import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from claimforge.fixtures import Claims
from claimforge.functions.ranks import between_cuts, cuts_of, quantiles, running, score_slot
from claimforge.functions.text import clip, ellipsis, html_to_text, references_decoded, tag_list, title
from claimforge.operators import analytics, events, gold, intake, ml, profile, quality, reasons, remediation, retrieval, retrieval_analytics, silver, terms
from claimforge.plans import claims as claims_plans
from claimforge.plans import registry
from claimforge.sources import io


def test_title_after_every_non_letter(spark):
    row = spark.createDataFrame([("o'neil heart-lung",), (None,)], "t string").select(title(F.col("t")).alias("t")).collect()
    assert [r.t for r in row] == ["O'Neil Heart-Lung", None]


def test_clip_keeps_null(spark):
    rows = spark.createDataFrame([(None,), (-500.0,), (900.0,)], "x double").select(clip(F.col("x"), -100, 500).alias("x")).collect()
    assert [r.x for r in rows] == [None, -100, 500]


def test_text_helpers(spark):
    row = spark.createDataFrame([("<p>a &amp; b</p><script>x</script><p>c</p>", '["x","y"]', "z, w")], "h string, j string, c string").select(html_to_text(F.col("h")).alias("h"), tag_list(F.col("j")).alias("j"), tag_list(F.col("c")).alias("c"), ellipsis(F.lit("a" * 500)).alias("e")).first()
    assert row.h.split() == ["a", "&", "b", "c"] and row.j == ["x", "y"] and row.c == ["z", "w"] and len(row.e) == 420 and row.e.endswith("…")


CLAIM = "claim_id string, patient_id string, provider_id string, diagnosis_code string, procedure_code string, billed_amount double, date string, denial_flag int"


def test_clean_claims(spark):
    raw = spark.createDataFrame([("c1", "p", "v", " d1 ", None, -5.0, "not-a-date", 1), ("c1", "p", "v", "d1", "x", 7.0, "2024-01-02", 0), ("c2", "p", "v", None, "p9", None, "2024-01-03", 0)], CLAIM)
    rows = {r.claim_id: r for r in silver.clean_claims(raw).collect()}
    assert len(rows) == 2
    a, b = rows["c1"], rows["c2"]
    assert (a.billed_amount, a.date, a.diagnosis_code, a.procedure_code, a.diag_no_proc) == (None, None, "D1", "MISSING", True)
    assert (b.diagnosis_code, b.proc_no_diag, b.billed_amount_missing) == ("MISSING", True, True)


def test_empty_tables(spark):
    raw = spark.createDataFrame([], CLAIM)
    assert silver.clean_claims(raw).count() == 0
    assert analytics.overview(raw).first().total_claims == 0
    assert all(r.claim_count == 0 and r.pct == 0 for r in analytics.completeness(silver.clean_claims(raw)).collect())


def test_tiered_benchmark_keeps_rows(spark):
    claims = spark.createDataFrame([("c1", "P1", "Delhi", 50.0), ("c2", "P1", "Goa", 50.0), ("c3", "P9", "Goa", 50.0)], "claim_id string, procedure_code string, location string, billed_amount double")
    cost = spark.createDataFrame([("P1", "Delhi", 10.0, 20.0, 0.5), ("P1", "Mumbai", 20.0, 40.0, 0.5)], "procedure_code string, region string, average_cost double, expected_cost double, cost_ratio double")
    out = {r.claim_id: (r.cost_match_level, r.expected_cost) for r in gold.add_benchmark(claims, cost).collect()}
    assert out == {"c1": ("regional", 20.0), "c2": ("procedure_avg", 30.0), "c3": ("missing", None)}


def test_label_falls_back_to_synthetic(spark):
    base = spark.createDataFrame([("c1", True, True, True, False, False, 300.0, 5), ("c2", False, False, False, False, False, None, 1)], "claim_id string, diagnosis_code_missing boolean, procedure_code_missing boolean, billed_amount_missing boolean, proc_no_diag boolean, diag_no_proc boolean, billed_deviation_pct double, denial_flag int")
    rows = {r.claim_id: r for r in gold.resolve_label(base, noise=0).collect()}
    assert rows["c1"].label_source == "synthetic" and rows["c1"].denial_flag == 1 and rows["c2"].denial_flag == 0


def test_threshold_keeps_recall(spark):
    df = spark.createDataFrame(list(zip([0, 0, 0, 1, 1, 1], [0.05, 0.2, 0.4, 0.6, 0.8, 0.95])), "label int, score double")
    best = ml.choose_threshold(df).first()
    assert best.recall == 1.0 and best.precision == 1.0 and 0.4 < best.threshold <= 0.6
    assert ml.area(df).first().roc_auc == 1.0


def test_contract_fills_and_reports(spark):
    df = spark.createDataFrame([("300", None), ("x", True)], "severity_rank string, is_high_cost boolean")
    out = quality.enforce(df, quality.CONTRACTS["gold_claim_features"]).collect()
    assert [(r.severity_rank, r.is_high_cost) for r in out] == [(0, False), (0, True)]
    assert quality.contract_issues(df, {"severity_rank": "tinyint!"}).first().actual == "string"


def test_validation_codes(spark):
    lookups = {"provider_history": spark.createDataFrame([("v",)], "provider_id string"), "diagnosis": spark.createDataFrame([("D1",)], "diagnosis_code string"), "procedure_cost": spark.createDataFrame([], "procedure_code string")}
    claims = spark.createDataFrame([("c1", "p", None, "d2", "p1", "abc"), ("c2", "p", "v", " ", "p1", "5")], "claim_id string, patient_id string, provider_id string, diagnosis_code string, procedure_code string, billed_amount string")
    rows = {r.claim_id: r for r in intake.validate(claims, lookups).collect()}
    assert [e.code for e in rows["c1"].blocking_errors] == ["CLAIM_ERR_REQUIRED_FIELD_MISSING", "CLAIM_ERR_INVALID_AMOUNT"]
    assert [w.code for w in rows["c1"].warnings] == ["CLAIM_WARN_UNKNOWN_DIAGNOSIS"]
    assert [w.code for w in rows["c2"].warnings] == ["CLAIM_WARN_MISSING_DIAGNOSIS", "CLAIM_WARN_PROC_WITHOUT_DIAGNOSIS"] and rows["c2"].is_valid


def test_reasons_critical_first_and_once(spark):
    features = spark.createDataFrame([("c1", True, False, False, False, False)], "claim_id string, diagnosis_code_missing boolean, procedure_code_missing boolean, billed_amount_missing boolean, proc_no_diag boolean, diag_no_proc boolean")
    top = spark.createDataFrame([("c1", 1, "is_high_cost", 1.0, 0.9), ("c1", 2, "billed_amount_imputed", 5.0, 0.8), ("c1", 3, "severity_rank", 2.0, -0.5), ("c1", 4, "mystery", 2.0, 0.1)], "claim_id string, rank int, feature string, value double, contribution double")
    levels = spark.createDataFrame([("c1", "HIGH")], "claim_id string, risk_level string")
    rows = reasons.select_reasons(features, top, levels).orderBy("reason_rank").collect()
    assert [(r.reason_code, r.evidence_type) for r in rows] == [("MISSING_DIAGNOSIS", "critical_rule"), ("HIGH_BILLING_AMOUNT", "shap")]
    assert [r.feature for r in reasons.unmapped(top).collect()] == ["mystery"]


def test_windows_cover_the_tail(spark):
    docs = spark.createDataFrame([("d", "s", "intro words here\n# Title\n" + " ".join(f"w{i}" for i in range(1000)))], "document_id string, source_name string, text string")
    rows = retrieval.windows(retrieval.sections(docs)).orderBy("section_index", "window_index").collect()
    assert [(r.section_title, r.n_words) for r in rows] == [(None, 3), ("Title", 420), ("Title", 420), ("Title", 300)]


def test_boosted_trees_are_registered_with_all_rounds(spark, small, monkeypatch):
    asked, fit = [], ml.fit
    monkeypatch.setattr(ml, "fit", lambda data, kind, rounds=200: asked.append(rounds) or fit(data, kind, 1))
    registry.QUERIES["m4_boosted_trees"](spark, small)
    assert asked == [200]


def test_corpus_scan_reads_every_document(spark, small, monkeypatch):
    texts, read = [], io.read_corpus

    def reading(session, path):
        out = read(session, path)
        texts.extend(r.text for r in out.select("text").collect())
        return out

    monkeypatch.setattr(io, "read_corpus", reading)
    documents = spark.read.parquet(f"{small}/documents.parquet")
    found = registry.QUERIES["io7_corpus"](spark, small).collect()
    assert sorted(texts) == sorted(r.text for r in documents.select("text").collect() if r.text)
    assert {r.document for r in found} == {r.source for r in documents.select("source").distinct().collect()}
    monkeypatch.setattr(io, "read_corpus", lambda session, path: read(session, path).where("text < 'm'"))
    assert len(registry.QUERIES["io7_corpus"](spark, small).collect()) < len(found)


def test_corpus_is_written_to_a_file_address(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", "one\n\ntwo\n"), ("b.txt", "é")], "name string, text string")
    io.write_corpus(rows, f"file:{tmp_path}/corpus")
    assert {r.source_name: r.text for r in io.read_corpus(spark, f"file:{tmp_path}/corpus").collect()} == {"a.txt": "one\n\ntwo\n", "b.txt": "é"}


def test_character_references_as_the_standard_has_them(spark):
    texts = ["&copy; 2020 &middot; a &amp;amp; b", "&#233;&#xE9;&#x1F642;", "&eacute &unknown; & &;", "", "&lt;p&gt; &#0; &#xD800; x", "no &hellip; &nbsp;end"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", references_decoded(F.col("t")).alias("t")).collect()
    got = {r.i: r.t for r in rows}
    assert got[6] is None and all(got[i] == html.unescape(t) for i, t in enumerate(texts))


def test_labels_keep_what_is_numeric(spark):
    raw = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "2"), ("d", None)], "claim_id string, denial_flag string")
    assert [r.denial_flag for r in silver.validate_labels(raw).orderBy("claim_id").collect()] == [1.0, None, 2.0, None]
    valid = silver.validate_labels(raw.where("claim_id = 'a'"))
    assert dict(valid.dtypes)["denial_flag"] == "int" and valid.first().denial_flag == 1


def test_enrichment_that_changes_the_rows_fails(spark):
    claims = spark.createDataFrame([("c1", "v1", "D1", "P1", 5.0)], "claim_id string, provider_id string, diagnosis_code string, procedure_code string, billed_amount double")
    providers = spark.createDataFrame([("v1", "General", "Goa")] * 2, "provider_id string, specialty string, location string")
    diagnosis = spark.createDataFrame([("D1", "Heart", "High")], "diagnosis_code string, category string, severity string")
    cost = spark.createDataFrame([("P1", "Goa", 1.0, 2.0, 0.5)], "procedure_code string, region string, average_cost double, expected_cost double, cost_ratio double")
    with pytest.raises(ValueError, match="providers"):
        gold.build_base(claims, providers, diagnosis, cost)
    assert gold.build_base(claims, providers.limit(1), diagnosis, cost).count() == 1


def test_low_risk_claims_get_no_risk_reasons_and_blocked_ones_only_fixes(spark):
    issue = "array<struct<code: string, field: string, message: string>>"
    checked = spark.createDataFrame([("low", [], []), ("high", [], [("CLAIM_WARN_MISSING_DIAGNOSIS", "diagnosis_code", "m")]), ("bad", [("CLAIM_ERR_INVALID_AMOUNT", "billed_amount", "no")], [])], f"claim_id string, blocking_errors {issue}, warnings {issue}")
    scores = spark.createDataFrame([("low", "LOW"), ("high", "HIGH"), ("bad", "HIGH")], "claim_id string, risk_level string")
    reasons_ = spark.createDataFrame([(c, 1, "MISSING_DIAGNOSIS", "fix", "text") for c in ("low", "high", "bad")], "claim_id string, reason_rank int, reason_code string, fix_suggestion string, reason_text string")
    evidence = spark.createDataFrame([("high", "MISSING_DIAGNOSIS", "b", 1), ("high", "MISSING_DIAGNOSIS", "a", 2)], "claim_id string, reason_code string, source_name string, policy_rank int")
    recs = remediation.recommendations(checked, scores, reasons_, evidence)
    got = {}
    for r in recs.orderBy("claim_id", "place").collect():
        got.setdefault(r.claim_id, []).append((r.priority, r.reason_code, r.evidence_source))
    assert got == {"low": [("LOW", None, None)], "high": [("HIGH", "MISSING_DIAGNOSIS", "b"), ("MEDIUM", "CLAIM_WARN_MISSING_DIAGNOSIS", None)], "bad": [("HIGH", "CLAIM_ERR_INVALID_AMOUNT", None)]}
    assert {r.claim_id: r.status for r in remediation.decisions(checked, scores, recs).collect()} == {"low": "READY_TO_SUBMIT", "high": "REVIEW_REQUIRED", "bad": "BLOCKED"}


def test_contracts_fill_what_may_not_be_null_and_keep_other_columns(spark):
    rows = spark.createDataFrame([("c", "7", None, "x", "kept"), ("d", "many", True, "2.5", None)], "claim_id string, patient_claim_count string, is_high_cost boolean, billed_amount string, other string")
    out = quality.enforce(rows, quality.CONTRACTS["gold_claim_features"])
    assert dict(out.dtypes) == {"claim_id": "string", "patient_claim_count": "int", "is_high_cost": "boolean", "billed_amount": "double", "other": "string"}
    assert [tuple(r) for r in out.orderBy("claim_id").collect()] == [("c", 7, False, None, "kept"), ("d", 0, True, 2.5, None)]
    assert [tuple(r) for r in quality.contract_issues(rows, quality.CONTRACTS["gold_claim_features"]).collect()] == [("billed_amount", "double", "string"), ("patient_claim_count", "int", "string")]


def explained(spark):
    """Three reasons of two claims, as the long table has them."""
    chosen = spark.createDataFrame([("c1", 1, "MISSING_DIAGNOSIS", "diagnosis_code_missing", 1.0, 0.5, "critical_rule"), ("c1", 2, "HIGH_BILLING_AMOUNT", "billed_deviation_imputed_capped", 12.34, -0.25, "shap"), ("c2", 1, "PROVIDER_HISTORY_RISK", "provider_violation_rate", 0.456, 0.0, "shap")], "claim_id string, reason_rank int, reason_code string, feature_name string, value double, contribution double, evidence_type string")
    scores = spark.createDataFrame([("c1", 0.8125, "HIGH", 1), ("c2", 0.1, "LOW", 0)], "claim_id string, risk_score double, risk_level string, predicted_denial int")
    return reasons.explanations(chosen, scores, created_at="now")


def test_explanations_have_every_contracted_column(spark):
    long = explained(spark)
    assert set(long.columns) == set(quality.CONTRACTS["gold_claim_explanations"])
    rows = {(r.claim_id, r.reason_rank): r for r in long.collect()}
    one = rows["c1", 2]
    assert (one.reason_text, one.feature_label, one.feature_value, one.shap_value, one.shap_direction) == ("The billed amount is about 12.3% above the expected benchmark for this procedure.", "Billing Deviation From Expected", "12.34", -0.25, "decreases_risk")
    assert rows["c2", 1].shap_direction == "neutral" and "0.46" in rows["c2", 1].reason_text
    short = reasons.summary(long)
    assert set(short.columns) == set(quality.CONTRACTS["gold_claim_explanation_summary"])
    c1 = short.where("claim_id = 'c1'").first()
    assert (c1.reason_1, c1.reason_2, c1.reason_3) == (rows["c1", 1].reason_text, one.reason_text, None)
    tags = [t for k in (1, 2) for t in json.loads(rows["c1", k].policy_tags)]
    assert json.loads(c1.policy_tags_json) == list(dict.fromkeys(tags)) and json.loads(c1.reason_codes) == ["MISSING_DIAGNOSIS", "HIGH_BILLING_AMOUNT"]


def best_chunks(asked, chunks, k=3):
    """The match rule in plain Python: sublinear tf-idf over words and pairs, a boost for each shared tag, a floor, the top k."""
    def counted(text):
        words = [w for w in re.findall(r"\b\w\w+\b", text.lower()) if w not in terms.english_stop_words()]
        return Counter(words + [" ".join(p) for p in zip(words, words[1:])])

    frequencies = {c.chunk_id: counted(c.chunk_text) for c in chunks}
    df = Counter(t for f in frequencies.values() for t in f)

    def vector(f):
        raw = {t: (1 + math.log(n)) * (math.log((1 + len(frequencies)) / (1 + df[t])) + 1) for t, n in f.items() if t in df}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}

    vectors, q = {c: vector(f) for c, f in frequencies.items()}, vector(counted(asked[0]))
    scored = []
    for c in chunks:
        raw = sum(w * vectors[c.chunk_id].get(t, 0) for t, w in q.items())
        shared = len(set(asked[1]) & set(c.policy_tags))
        if raw > 0 and raw + retrieval.BOOST * shared >= 0.05:
            scored.append((-round(raw + retrieval.BOOST * shared, 6), -shared, c.chunk_id))
    return [(c, -s) for s, _, c in sorted(scored)[:k]]


def test_matches_and_final_explanations_as_brute_force(spark):
    texts = ["# Coding\nA claim must include a diagnosis code that supports medical necessity of the procedure.", "# Amounts\nBilled amounts above expected cost need documentation; verify the cost benchmark.", "Provider history and credential review of the billing provider.", "# Other\nUnrelated words about weather."]
    docs = spark.createDataFrame([(f"d{i}", f"s{i}", "text", f"/p/{i}", t) for i, t in enumerate(texts)], "document_id string, source_name string, source_type string, source_path string, text string")
    corpus, long = retrieval.chunks(docs, created_at="now"), explained(spark)
    found = retrieval.matches(long, corpus, min_score=0.05, created_at="now")
    assert set(found.columns) == set(quality.CONTRACTS["gold_claim_policy_matches"])
    chunks, got = corpus.collect(), {}
    for r in found.orderBy("claim_id", "reason_rank", "policy_rank").collect():
        got.setdefault((r.claim_id, r.reason_code), []).append(r)
    for e in long.collect():
        want = best_chunks((f"{e.policy_query}\nReason: {e.reason_text}", json.loads(e.policy_tags)), chunks)
        assert [(r.policy_chunk_id, pytest.approx(r.similarity_score, abs=2e-6)) for r in got.get((e.claim_id, e.reason_code), [])] == want
    final = retrieval.final_explanations(found, "now")
    assert set(final.columns) == set(quality.CONTRACTS["gold_claim_final_explanations"])
    for f in final.collect():
        best = [rows[0] for (claim, _), rows in got.items() if claim == f.claim_id]
        places = [f"- {r.source_name}" + (f" / {r.section_title}" if r.section_title else "") + f": {r.policy_summary}" for r in best]
        assert f.final_explanation_text == f"Claim {f.claim_id} is {f.risk_level} risk with score {f.risk_score:.2%}.\n\nReasons:\n" + "\n".join(f"- {r.reason_title}: {r.reason_text}" for r in best) + "\n\nPolicy support:\n" + "\n".join(places) + "\n\nRecommended actions:\n" + "\n".join(f"- {r.fix_suggestion}" for r in best)
        assert json.loads(f.reasons_json) == [{c: r[c] for c in ("reason_code", "reason_title", "reason_text", "fix_suggestion")} for r in best]
        assert json.loads(f.policies_json) == [{c: r[c] for c in ("reason_code", "source_name", "section_title", "page_number", "policy_summary", "similarity_score")} for r in best]
        assert json.loads(f.recommended_actions_json) == list(dict.fromkeys(r.fix_suggestion for r in best))


def test_quantiles_and_running_sums_as_the_whole_sort_has_them(spark):
    values = [(k, v) for k in ("a", "b") for v in (-7.5, -0.25, 0.0, 0.0, 0.001, 3.0, 3.0, 3.04, 90.0, 1e9)] + [("c", 5.0), ("d", None), ("e", float("nan")), ("a", 12.0)]
    df = spark.createDataFrame(values, "k string, v double")
    found = {r.k: (r.q1, r.mid, r.top) for r in quantiles(df, F.col("v"), ("k",), q1=0.25, mid=0.5, top=0.97).collect()}
    for k in "abc":
        want = np.quantile([v for g, v in values if g == k], (0.25, 0.5, 0.97))
        assert np.allclose(found.pop(k), want)
    assert not found
    held = [v for _, v in values if v is not None and v == v]
    assert np.isclose(quantiles(df, F.col("v"), mid=0.5).first().mid, np.median(held))
    assert quantiles(df.where("false"), F.col("v"), mid=0.5).collect() == [(None,)]
    rows = [(i / 10_000, i % 3) for i in range(0, 10_001, 7)]
    placed = running(spark.createDataFrame(rows, "score double, n int"), "score", score_slot(F.col("score")), "n").collect()
    assert sorted((r.score, r.n_before, r.n_all) for r in placed) == [(s, sum(n for x, n in rows[:i]), sum(n for _, n in rows)) for i, (s, _) in enumerate(rows)]


def test_logistic_weights_as_a_closed_loop_finds_them(spark):
    """The fitted pipeline's weights against Newton steps on the same penalised, balanced likelihood."""
    r = np.random.default_rng(11)
    names = ml.FEATURES[:3]
    x = r.normal(size=(400, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = (r.random(400) < 1 / (1 + np.exp(-(x @ [1.2, -0.3, 2.0] - 1)))).astype(int)
    df = spark.createDataFrame([(f"c{i}", int(y[i]), *map(float, x[i]), "train") for i in range(400)], f"claim_id string, denial_flag int, {', '.join(f'{c} double' for c in names)}, part string")
    model = ml.pipeline("logistic", names).fit(ml.weighted(df))
    weights, means, base = ml.linear_weights(model, names)
    z = np.column_stack([np.ones(400), (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)])
    w = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    beta, ridge = np.zeros(4), 1e-4 * w.sum() * np.diag([0, 1, 1, 1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z.T * (w * p * (1 - p))) @ z + ridge, z.T @ (w * (p - y)) + ridge @ beta)
    want = beta[1:] / x.std(axis=0, ddof=1)
    assert np.allclose([weights[c] for c in names], want, rtol=1e-3) and abs(base - beta[0]) < 1e-3
    assert np.allclose([means[c] for c in names], x.mean(axis=0))


class Visible(HTMLParser):
    """Visible text as html_to_text() has it, by a parser instead of patterns."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "svg")
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "svg") and self.hidden > 0
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)

    def text(self):
        t = re.sub(r"[ \t\r\xa0]+", " ", "".join(self.parts))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", t)).strip()


BLOCKS = "p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav".split()


def test_pages_as_text_as_a_parser_reads_them(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html", html_to_text(F.col("html")).alias("text")).collect()
    for r in pages:
        parser = Visible()
        parser.feed(r.html)
        parser.close()
        assert r.text == parser.text()


def test_values_close_together_and_bursts_are_dealt_evenly(spark):
    """A million different values within a hundredth of one another, and events of one fingerprint in a burst: no slot has a twentieth of them."""
    close = spark.range(1_000_000).select((F.lit(100.0) + F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0).alias("v")).distinct()
    n = close.count()
    placed = between_cuts(close, F.col("v"), cuts_of(close, F.col("v"))).groupBy("_place").count().agg(F.max("count"), F.count("*"), F.min("_place"), F.max("_place")).first()
    assert n > 600_000 and placed[0] < 0.05 * n and placed[1] > 200 and placed[2] >= 0 and placed[3] <= 255
    got = quantiles(close, F.col("v"), m=0.5, p=0.99).first()
    want = np.quantile(np.sort(np.array([r.v for r in close.toLocalIterator()])), [0.5, 0.99])
    assert abs(got.m - want[0]) < 1e-12 and abs(got.p - want[1]) < 1e-12
    burst = spark.range(20_000).select(F.col("id").alias("event_id"), F.timestamp_micros(F.when(F.col("id") < 19_990, 10**12 + F.col("id") * 7 % 20_011).otherwise(F.col("id") * 10**12)).alias("ts"), F.lit("f").alias("fingerprint"))
    numbered = events.occurrences(burst)
    rows = numbered.select("event_id", "occurrence", "ts").collect()
    assert [r.occurrence for r in sorted(rows, key=lambda r: (r.ts, r.event_id))] == list(range(1, 20_001))
    slots = between_cuts(burst, F.unix_micros("ts"), cuts_of(burst, F.unix_micros("ts"))).groupBy("_place").count().agg(F.max("count")).first()[0]
    assert slots < 0.05 * 20_000


def test_cuts_of_few_many_and_no_values(spark):
    for values in ([], [None], [3.0], [2.0] * 50, [float("-inf"), -1.0, 0.0, float("inf")], list(map(float, range(1000)))):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        rows = between_cuts(df, F.col("v"), cuts_of(df, F.col("v"))).collect()
        assert len(rows) == len(values) and all(0 <= r["_place"] <= 255 for r in rows)
        places = [r["_place"] for r in sorted((r for r in rows if r.v is not None), key=lambda r: r.v)]
        assert places == sorted(places)


def test_features_read_the_base_a_few_times(spark, small):
    """Scans of the written base in the plan of all features, those of exchanges that are used again not counted."""
    t = Claims(spark, small)
    plan = gold.build_features(t.base)
    plan.write.format("noop").mode("overwrite").save()
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text[: text.index("Initial Plan")] if "Initial Plan" in text else text
    assert final.count("Scan parquet") <= 6, final.count("Scan parquet")


def test_fitted_contributions_add_up_to_the_models_log_odds(spark, small):
    data = ml.split(ml.design_matrix(Claims(spark, small).features)).persist()
    model = ml.fit(data)
    test = data.where("part = 'test'")
    total = ml.fitted_contributions(model, test).groupBy("claim_id").agg(F.sum("contribution").alias("total"))
    p = model.transform(test).select("claim_id", vector_to_array("rawPrediction")[1].alias("log_odds"))
    rows = total.join(p, "claim_id").collect()
    assert len(rows) == test.count() > 100
    assert max(abs(r.total - r.log_odds) for r in rows) < 1e-3


def test_the_better_model_is_selected_and_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(1, 0.9, 0.4, 0.9), (0, 0.2, 0.1, 0.2), (1, 0.7, 0.6, 0.7), (0, 0.8, 0.3, 0.8)], "label int, a double, b double, c double")
    chosen = lambda **scores: [r.model for r in ml.compare(df, scores).where("selected").collect()]
    assert chosen(first="a", second="b") == ["second"]
    assert chosen(first="c", second="a") == ["first"]


def test_numeric_profile_of_an_empty_table_lists_its_columns(spark):
    rows = profile.numeric_profile(spark.createDataFrame([], "id string, x double, y int")).collect()
    assert sorted((r["column"], r["count"], r.p50) for r in rows) == [("x", 0, None), ("y", 0, None)]


def test_claims_that_contradict_themselves_are_errors_and_the_rest_get_the_models_score(spark, small):
    t = Claims(spark, small)
    model = ml.fit(ml.split(ml.design_matrix(t.features)))
    found = intake.score(t.claims, claims_plans.lookups(t), ml.scorer(model))
    wanted = ml.predict(model, ml.design_matrix(t.features)).select("claim_id", F.col("risk_score").alias("wanted"))
    apart = [abs(r.risk_score - r.wanted) for r in found.where("status = 'success'").join(wanted, "claim_id").collect()]
    assert len(apart) == t.claims.count() and sorted(apart)[int(len(apart) * 0.95)] < 0.01, sorted(apart)[:: len(apart) // 20]
    plain = t.claims_raw.limit(5).withColumn("denial_flag", F.lit(1))
    assert intake.contradictions(plain).where("contradiction is not null").count() == 0


def test_only_the_lookups_that_a_query_reads_are_written(spark, small, tmp_path):
    from claimforge import fixtures
    from claimforge.plans import decisions

    (tmp_path / "data").symlink_to(small)
    decisions.checked(fixtures.Claims(spark, str(tmp_path / "data")))
    written = {layer for _, folder, layer in fixtures._written if folder == str(tmp_path / "data")}
    assert {x for x in written if x.startswith("lookup_")} == {"lookup_provider_history", "lookup_diagnosis", "lookup_procedure_cost"}


def test_recommendations_find_a_claims_actions_in_one_row(spark):
    checked = spark.createDataFrame([("a", [], [("CLAIM_WARN_AMOUNT_MISSING",)]), ("b", [("x", None, "E")], []), ("c", [], []), ("c", [], []), ("d", [], [])], "claim_id string, blocking_errors array<struct<message:string,field:string,code:string>>, warnings array<struct<code:string>>")
    scores = spark.createDataFrame([("a", "HIGH"), ("b", "HIGH"), ("c", None), ("e", "HIGH")], "claim_id string, risk_level string")
    given = spark.createDataFrame([("a", 1, "MISSING_DIAGNOSIS", None, None), ("a", 2, "OWN", None, "text"), ("a", 3, "MISSING_DIAGNOSIS", None, None), ("b", 1, "OWN", "f", "t"), ("e", 1, "OWN", "f", "t")], "claim_id string, reason_rank int, reason_code string, fix_suggestion string, reason_text string")
    evidence = spark.createDataFrame([("a", "OWN", "late", 2), ("a", "OWN", "first", 1), ("z", "OWN", "other", 1)], "claim_id string, reason_code string, source_name string, policy_rank int")
    recs = remediation.recommendations(checked, scores, given, evidence)
    rows = [(r.claim_id, r.place, r.priority, r.reason_code, r.evidence_source) for r in recs.orderBy("claim_id", "place").collect()]
    assert rows == [("a", 101, "HIGH", "MISSING_DIAGNOSIS", None), ("a", 102, "HIGH", "OWN", "first"), ("a", 200, "MEDIUM", "CLAIM_WARN_AMOUNT_MISSING", None), ("b", 0, "HIGH", "E", None), ("c", 300, "LOW", None, None)]
    plan = recs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 3 and "Union" not in plan


def test_layers_leave_no_shuffles_and_quartiles_need_no_texts(spark, small, tmp_path):
    from glob import glob

    from claimforge import fixtures

    shuffled = lambda: {f for f in glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*.data", recursive=True)}
    t, before = fixtures.Claims(spark, str(tmp_path)), shuffled()
    made = t.layer("counts", lambda: spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count().repartition(3))
    assert not shuffled() - before and made.count() == 1000 and spark.conf.get(fixtures.CLEANUP, None) is None
    (tmp_path / "data").symlink_to(small)
    assert registry.QUERIES["v8_similarity_quartiles"](spark, str(tmp_path / "data")).count() > 0
    written = {layer for _, folder, layer in fixtures._written if folder == str(tmp_path / "data")}
    assert "explanations" not in written and "policy_similarities" in written


def test_quartiles_read_their_matches_once(spark):
    rows = [("a", "R", i % 7, "s", None, None if i == 3 else i / 10) for i in range(10)] + [("b", "S", 1, "s", "t", 0.5)]
    df = spark.createDataFrame(rows, "claim_id string, reason_code string, policy_chunk_id long, source_name string, section_title string, similarity_score double")
    kept = {}
    found = retrieval_analytics.similarity_quartiles(df, 1, lambda frame, name: kept.setdefault(name, spark.createDataFrame(frame.collect(), frame.schema)))
    # of the rows of a key the best score counts, and a null one where there is no other
    assert {(r.reason_code, r.v, r.n) for r in kept["similarities"].collect()} == {("R", v, 1) for v in (None, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)} | {("S", 0.5, 1)}
    assert [r.reason_code for r in found.collect()] == ["R"] and np.allclose(found.drop("reason_code").first(), np.quantile([0.4, 0.5, 0.6, 0.7, 0.8, 0.9], (0.25, 0.5, 0.75)))


def test_final_explanations_write_no_match_table(spark, small, tmp_path):
    from claimforge import fixtures

    (tmp_path / "data").symlink_to(small)
    registry.QUERIES["r14_final"](spark, str(tmp_path / "data"))
    written = {layer for _, folder, layer in fixtures._written if folder == str(tmp_path / "data")}
    assert "policy_index" in written and "policy_match_table" not in written
