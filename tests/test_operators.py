"""Literal cases, one table for each operator."""

import collections
import datetime
import difflib
import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.functions import mrz, text, values
from quire.operators import checks, conversion, drafting, extract, flow, match, retrieval, store
from quire.operators import lines as L
from quire.streaming import lifecycle

TODAY = datetime.date(2026, 7, 3)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def judge(spark, fields, rules, **context):
    df = spark.createDataFrame([(1, fields)], "doc_id long, fields map<string,string>")
    for name in ("holder",):
        if name in context:
            df = df.withColumn("declared", F.lit(context[name]).cast("string"))
            context[name] = "declared"
    row = checks.evaluate(df, rules, checks.Context(today=TODAY, **context)).first()
    return row["verdict"], row["reasons"]


SUM = [{"check": "sum", "terms": ["ht", "tva"], "equals": "ttc"}]


@pytest.mark.parametrize(
    "ht, tva, ttc, verdict",
    [("1000.00", "200.00", "1200.00", "auto"), ("1000.00", "200.00", "1300.00", "review"), ("100.00", "33.33", "133.34", "auto"), ("100.00", "33.33", "133.40", "review"), ("1234,50", "246,90", "1481,40", "auto"), ("1000.00", "200.00", None, "review"), ("1000.00", "n/a", "1200.00", "review"), ("nan", "1", "1", "review")],
)
def test_sum(spark, ht, tva, ttc, verdict):
    assert judge(spark, {"ht": ht, "tva": tva, "ttc": ttc}, SUM)[0] == verdict


ORDER = [{"check": "date_order", "earlier": "a", "later": "b", "require_future": True}]


@pytest.mark.parametrize(
    "a, b, verdict, n",
    [("2024-03-12", "2027-03-12", "auto", 0), ("2027-03-12", "2024-03-12", "reject", 2), ("2020-03-12", "2023-03-12", "reject", 1), ("2024-03-12", None, "review", 1), ("20240312", "20270312", "auto", 0), ("2024-3-12", "2027-03-12", "review", 1), ("2024-02-30", "2027-03-12", "review", 1)],
)
def test_date_order(spark, a, b, verdict, n):
    found = judge(spark, {"a": a, "b": b}, ORDER)
    assert (found[0], len(found[1])) == (verdict, n)


@pytest.mark.parametrize("a, b, verdict", [("2024-03-12", "2027-03-12", "auto"), ("2024-03-12", "2029-03-12", "reject"), ("2024-02-29", "2027-02-28", "auto"), ("2024-03-12", "2027-03-14", "auto"), ("2024-03-12", "2027-03-15", "reject")])
def test_date_span(spark, a, b, verdict):
    assert judge(spark, {"a": a, "b": b}, [{"check": "date_span", "start": "a", "end": "b", "years": 3}])[0] == verdict


@pytest.mark.parametrize("value, verdict", [("H0B0 B1V", "auto"), ("h0b0 br", "auto"), ("H0B0 B9Z", "reject"), ("", "review"), (None, "review"), (" ;, ", "auto")])
def test_vocabulary(spark, value, verdict):
    assert judge(spark, {"c": value}, [{"check": "vocabulary", "field": "c", "allowed": ["H0B0", "B1V", "B2V", "BR", "BC", "B0", "H0"]}])[0] == verdict


@pytest.mark.parametrize("value, holder, verdict", [("FICTIF Ahmed", "FICTIF Ahmed", "auto"), ("FICTIF Gaelle", "FICTIF Gaëlle", "auto"), ("FICTIF Hamed", "FICTIF Ahmed", "reject"), ("FICTIF Ahmed", None, "review"), ("", "FICTIF Ahmed", "review")])
def test_holder(spark, value, holder, verdict):
    assert judge(spark, {"h": value}, [{"check": "reconcile_ci", "field": "h"}], holder=holder)[0] == verdict


def test_registry_and_severity(spark):
    known = spark.createDataFrame([("123 456 789 00012",), ("987 654 321 00034",)], "id string")
    rule = {"check": "issuer_registry", "field": "i"}
    assert judge(spark, {"i": "12345678900012"}, [rule], registry=known)[0] == "auto"
    assert judge(spark, {"i": "00000000000000"}, [rule], registry=known)[0] == "review"
    assert judge(spark, {"i": "00000000000000"}, [rule | {"severity": "reject"}], registry=known)[0] == "reject"
    assert judge(spark, {"i": "00000000000000"}, [rule | {"severity": "reject"}])[0] == "review"
    verdict, reasons = judge(spark, {"i": "12345678900012"}, [rule | {"severity": "typo"}], registry=known)
    assert verdict == "review" and reasons == ["unknown severity 'typo' on check 'issuer_registry' — config error (expected 'reject' or 'review'), routed to review"]
    assert judge(spark, {}, [{"check": "astrology"}])[1] == ["unknown validation check: 'astrology'"]


def test_corroboration(spark):
    files = spark.createDataFrame([("FICTIF Ahmed", "2024-01-10", "2027-01-10"), ("FICTIF Bruno", "2023-05-01", "2026-05-01"), ("X", "soon", "2026-05-01")], "holder_name string, issue_date string, expiry_date string")
    rule = [{"check": "corroborated_by", "holder_field": "h", "issue_field": "d"}]
    assert judge(spark, {"h": "fictif ahmed", "d": "2024-03-12"}, rule, attestations=files)[0] == "auto"
    for fields in ({"h": "INCONNU Sophie", "d": "2024-03-12"}, {"h": "FICTIF Ahmed", "d": "2023-01-01"}, {"h": "FICTIF Ahmed", "d": None}, {"h": "", "d": "2024-03-12"}):
        assert judge(spark, fields, rule, attestations=files)[0] == "review"
    assert "no validated attestations on file" in judge(spark, {"h": "FICTIF Ahmed", "d": "2024-03-12"}, rule)[1][0]


def test_precedence_keeps_both_buckets(spark):
    rules = [{"check": "present", "field": "x"}, {"check": "vocabulary", "field": "c", "allowed": ["A"]}]
    verdict, reasons = judge(spark, {"c": "B"}, rules)
    assert verdict == "reject" and reasons == ["vocabulary check failed (c): B not in the allowed list", "x: required (presence) but not read"]


def test_strict_key(spark):
    key = lambda s: one(spark, text.strict_key(F.lit(s).cast("string")))
    assert key("Maelys-Gaëlle") == key("MAELYS GAELLE") and key("AIT-ALLA") == key("AIT ALLA") and key("Gaëlle") != key("GAELE")
    assert key(None) == key("--") == "" and key("straße") == "STRASSE" and key("œuf") == "UF"
    rnd = random.Random(2)
    letters = [chr(c) for c in (*range(0x20, 0x7F), *range(0xC0, 0x180), *range(0x1E00, 0x1EFF))]
    for _ in range(30):
        s = "".join(rnd.choice(letters) for _ in range(30))
        plain = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).upper()
        assert key(s) == "".join(c for c in plain if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def test_values(spark):
    assert one(spark, text.normalise_value(F.lit(" 12/03/2024 "), "date_ddmmyyyy")) == "2024-03-12"
    assert one(spark, text.normalise_value(F.lit("12/03/24"), "date_ddmmyyyy")) == "12/03/24"
    assert one(spark, text.normalise_value(F.lit("1 234 567 ,5"), "amount")) == "1234567,5"
    assert one(spark, values.amount(F.lit("12d"))) is None and one(spark, values.amount(F.lit("1e3"))) == 1000.0
    assert one(spark, text.slug(F.lit("Réf. n° 4!"))) == "ref_n_4" and one(spark, text.slug(F.lit("日本"))) == "champ"
    assert one(spark, text.reference_key(F.lit("selon l'Avenant n°7"))) == "avenant 7"
    assert one(spark, text.is_document_reference(F.lit("Les Articles 2 et 3"))) and not one(spark, text.is_document_reference(F.lit("avant le terme du Contrat")))
    assert one(spark, text.quoted(F.lit("O'Neill"))) == repr("O'Neill") and one(spark, text.quoted(F.lit("a\\b"))) == repr("a\\b")


def test_integrity(spark):
    kind = lambda s: one(spark, text.integrity(F.lit(s)))
    good = "été à Noël"
    assert kind(good)["disposition"] == "clean" and kind("L'humanité à Noël règle la réflexion.")["disposition"] == "clean"
    bad = kind(good.encode().decode("latin-1"))
    assert (bad["disposition"], bad["repaired"]) == ("repairable_mojibake", good)
    lost = kind("abc�def")
    assert (lost["disposition"], lost["replacement_count"], lost["repaired"]) == ("irreversible_loss", 1, None)


def test_mrz(spark):
    assert one(spark, mrz.check_digit(F.lit("870314"))) == 5 and one(spark, mrz.check_digit(F.lit("<<<"))) == 0
    td1 = ["IDFRAX4RTBPFW46<<<<<<<<<<<<<<<", "9007138F3002119FRA<<<<<<<<<<<6", "MARTIN<<MAELYS<GAELLE<MARIE<<<"]
    m = one(spark, mrz.parse(F.array(*map(F.lit, td1))))
    assert (m["mrz_format"], m["surname"], m["given_names"], m["birth_date"], m["expiry_date"], m["sex"], m["document_number"]) == ("td1", "MARTIN", "MAELYS GAELLE MARIE", "1990-07-13", "2030-02-11", "F", "X4RTBPFW4")
    assert m["checks"] == {"document_number": True, "birth_date": True, "expiry_date": True, "composite": True}
    only = one(spark, mrz.parse_td1(F.array(F.lit(td1[2]), F.lit("garbled<<line"))))
    assert only["surname"] == "MARTIN" and only["birth_date"] is None and only["checks"] == {}


RECTO = {"nom": "DUPONT", "prenoms": "JEAN", "date_naissance": "1990-01-01", "date_expiration": "2030-01-01", "numero_document": "ABC123456"}


@pytest.mark.parametrize("change, digits, verdict", [({}, True, "auto"), ({"nom": "MARTIN"}, True, "reject"), ({}, False, "review"), (None, True, "review")])
def test_reconcile(spark, change, digits, verdict):
    recto = {} if change is None else RECTO | change
    row = [(1, recto, ("DUPONT", "JEAN", "1990-01-01", "2030-01-01", None, "ABC123456", {"birth_date": digits}))]
    df = spark.createDataFrame(row, "doc_id long, r map<string,string>, m struct<surname:string,given_names:string,birth_date:string,expiry_date:string,sex:string,document_number:string,checks:map<string,boolean>>")
    assert df.select(flow.reconcile(F.col("r"), F.col("m")).alias("v")).first()["v"]["verdict"] == verdict


@pytest.mark.parametrize("scale", [1, 2])
def test_geometry_follows_the_scale(spark, scale):
    raw = [("Nom", 100, 100, 120), ("DUPONT", 140, 160, 200), ("Numero", 600, 100, 130), ("X4T29", 750, 113.6, 140)]
    rows = [(1, i, t, x * scale * 1.0, y * scale * 1.0, (x + w) * scale * 1.0, (y + 34) * scale * 1.0, 0, 1066.0 * scale, 694.0 * scale) for i, (t, x, y, w) in enumerate(raw)]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, text string, x0 double, y0 double, x1 double, y1 double, page_index int, page_width double, page_height double")
    anchors = spark.createDataFrame([(1, "nom", 0), (1, "numero", 2)], "doc_id long, field string, anchor_line int")
    below = {r["field"]: r["text"] for r in extract.value_below(lines, anchors).collect()}
    right = {r["field"]: r["text"] for r in extract.value_right(lines, anchors).collect()}
    assert below["nom"] == "DUPONT" and right["numero"] == "X4T29"


@pytest.mark.parametrize("find", [extract.value_below, extract.value_right])
def test_no_lines_are_broadcast(spark, find):
    lines = L.text_lines(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("a\nb").alias("text")))
    found = find(lines, lines.where("line_no = 0").select("doc_id", F.lit("a").alias("field"), F.col("line_no").alias("anchor_line")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 3 and "Broadcast" not in plan


def test_provenance_is_a_share_of_the_page(spark):
    row = spark.createDataFrame([(10.0, 30.0, 90.0, 45.0, 0, 1000.0, 500.0), (1.0, 1.0, 2.0, 2.0, 0, 0.0, 0.0)], "x0 double, y0 double, x1 double, y1 double, page_index int, page_width double, page_height double")
    found = [r["p"] for r in row.select(L.provenance({c: F.col(c) for c in row.columns}).alias("p")).collect()]
    assert found[0]["bbox"] == [0.01, 0.06, 0.09, 0.09] and found[1] is None


def test_patterns_keep_spans(spark):
    docs = spark.createDataFrame([(1, "\U0001f600 Facture N. F-2026-0042\nTotal HT 1 250,00"), (2, "rien"), (3, None)], "doc_id long, text string")
    found = {r["field"]: (r["value"], r["char_start"]) for r in extract.pattern_spans(docs, {"n": r"Facture N\. (\S+)", "o": r"(zzz)?rien"}).collect()}
    assert found == {"n": ("F-2026-0042", 13)}
    assert one(spark, extract.pattern_value(F.lit("Total HT 1 250,00"), r"Total HT\s+([\d\s]+,\d{2})", "amount")) == "1250,00"
    with pytest.raises(ValueError):
        extract.pattern_value(F.lit("x"), "(?P<a>x)")
    spans = one(spark, L.word_spans(F.lit("le la le"), F.array(F.lit("le"), F.lit("xx"), F.lit("le"))))
    assert [(s["start"], s["end"]) for s in spans] == [(0, 2), (6, 8)]


def test_fuzzy_containment_is_the_ratio():
    assert match.near_enough("surname", "givensumame") and not match.near_enough("nom", "nam") and not match.near_enough("", "x")
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randrange(4, 9))) for _ in range(2))
        windows = [b[i : i + n] for n in (len(a) - 1, len(a), len(a) + 1) for i in range(len(b) - n + 1)]
        assert match.near_enough(a, b) == (a in b or any(difflib.SequenceMatcher(None, a, w).ratio() >= 0.75 for w in windows))


def test_first_template_wins_and_slips_are_forgiven(spark):
    templates = match.templates_table(spark, [{"template_id": "a", "match": {"all_anchors": ["Surname", "Total"]}}, {"template_id": "b", "match": {"all_anchors": ["Total"]}}, {"template_id": "c", "match": {"all_anchors": []}}])
    docs = spark.createDataFrame([(1, "Sumame\nTOTAL 4"), (2, "the total"), (3, "none")], "doc_id long, text string")
    found = {r["doc_id"]: r["template_id"] for r in match.match_templates(L.text_lines(docs), templates).collect()}
    assert found == {1: "a", 2: "b"}


def test_templates_from_files(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"template_id": "two", "category": "x", "match": {"all_anchors": ["B"]}}')
    (tmp_path / "a.json").write_text('{"template_id": "one", "category": "y", "match": {"all_anchors": ["A", "C"]}}')
    rows = match.read_templates(spark, str(tmp_path)).orderBy("template_order").collect()
    assert [(r["template_id"], r["template_order"], r["anchors"]) for r in rows] == [("one", 0, ["A", "C"]), ("two", 1, ["B"])]


def test_chunks_close_at_the_target(spark):
    sizes = [50, 80, 10, 130, 5]
    made = one(spark, retrieval.packed(F.array(*(F.lit(str(i)) for i in range(5))), F.array(*map(F.lit, sizes)), 120))
    assert [c["tokens"] for c in made] == [130, 140, 5]
    texts = spark.createDataFrame([(i, "g", i, n) for i, n in enumerate([1500, 400, 200, 2500, 1])], "doc_id long, group string, pos int, tokens long")
    assert [r["batch_no"] for r in retrieval.token_batches(texts).orderBy("doc_id").collect()] == [0, 0, 1, 2, 3]


def plain_clusters(ids, edges):
    near = {i: set() for i in ids}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    clusters = []
    for i in sorted(ids):
        for c in clusters:
            if near[i] & set(c):
                c.append(i)
                break
        else:
            clusters.append([i])
    return {i: c[0] for c in clusters for i in c}


def test_greedy_clusters_never_merge(spark):
    rnd = random.Random(9)
    edges = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(55)}
    docs = spark.range(60).select(F.col("id").alias("doc_id"))
    made = drafting.greedy_clusters(docs, spark.createDataFrame(list(edges), "a long, b long"))
    assert {r["doc_id"]: r["cluster"] for r in made.collect()} == plain_clusters(range(60), edges)


@pytest.mark.parametrize("chance", [0.02, 0.2])
def test_greedy_clusters_of_one_large_component(spark, chance):
    rnd = random.Random(int(chance * 100))
    chain = {(i, i + 1) for i in range(0, 149, 2)}
    edges = chain | {(a, b) for a in range(150) for b in range(a + 1, 150) if rnd.random() < chance}
    given = [(b, a) if rnd.random() < 0.5 else (a, b) for a, b in sorted(edges)]
    docs = spark.range(152).select(F.col("id").alias("doc_id"))
    made = drafting.greedy_clusters(docs, spark.createDataFrame(given, "a long, b long"))
    assert {r["doc_id"]: r["cluster"] for r in made.collect()} == plain_clusters(range(152), edges)


def test_many_needles_find_the_same_lines(spark, monkeypatch):
    bodies = ["Apache Licence v2\nab", "an Apach licence", "a\nXYZ tail", None, "", "xyz"]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    needles = spark.createDataFrame([("apachelicence",), ("a",), ("ab",), ("xyz",), ("zta",), ("",), ("licence",)], "needle string")
    for fuzzy in (False, True):
        few = match.find_anchors(L.text_lines(docs), needles, fuzzy=fuzzy).collect()
        with monkeypatch.context() as patch:
            patch.setattr(match, "MOST_NEEDLES", 2)
            many = match.find_anchors(L.text_lines(docs), needles, fuzzy=fuzzy).collect()
        assert few and sorted(few) == sorted(many)


def test_names_are_unique(spark):
    labels = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Nom", "Nom 2", "nom", "NOM"])], "cluster long, label_no int, label string")
    assert [r["name"] for r in drafting.unique_names(labels).orderBy("label_no").collect()] == ["nom", "nom_2", "nom_3", "nom_4"]


def test_retry_schedule(spark):
    docs = spark.createDataFrame([(1, 10)], "doc_id long, pages int")

    def convert(ranges):
        each = ranges.withColumn("page", F.explode(F.sequence("range_start", "range_end")))
        lost = (F.col("page").isin(5, 6) & (F.col("range_end") - F.col("range_start") + 1 > 4)) | (F.col("page") == 9)
        return each.where(~lost).select("*", F.lit(1.0).alias("layout_score"), F.lit("success").alias("status"))

    done, missing = conversion.reconcile(docs, convert, schedule=(10, 5, 2, 1))
    made = {r["page"]: (r["width"], r["round"]) for r in done.collect()}
    assert made[5] == made[6] == (2, 1) and made[1] == (10, 0) and [r["page"] for r in missing.collect()] == [9]
    for bad in ([], [2, 0], [2, 2, 1], [4, 2]):
        with pytest.raises(ValueError):
            conversion.check_schedule(bad)


def test_store_keeps_what_it_should(spark):
    table = spark.createDataFrame([("a", 1, 3, "t0"), ("b", 2, 1, "t0")], "k string, v int, version int, created_at string")
    rows = spark.createDataFrame([("a", 9, "t1"), ("c", 7, "t1")], "k string, v int, created_at string")
    made = {r["k"]: tuple(r)[1:] for r in store.upsert(table, rows, "k", version="version").collect()}
    assert made == {"a": (9, 4, "t0"), "b": (2, 1, "t0"), "c": (7, 1, "t1")}
    fixed = one(spark, store.valid_corrections(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("3"), F.lit("z"), F.lit("4"))))
    assert fixed["changes"] == {"b": "3", "z": "4"} and fixed["unknown"] == ["z"]


def test_better_read_is_lazy(spark):
    reads = [(1, 0, {"a": False}), (1, 1, {"a": True}), (1, 2, {"a": True, "b": True}), (2, 0, {"a": False, "b": True}), (2, 1, {"a": True, "b": False})]
    df = spark.createDataFrame(reads, "doc_id long, tier int, checks map<string,boolean>")
    assert {r["doc_id"]: r["tier"] for r in flow.better_read(df).collect()} == {1: 1, 2: 0}


def test_replies_are_salvaged():
    from quire.operators import growth

    cut = 'ok ```[{"relation":"modifie","ancien":" Article 2 ","nouveau":""}, {"a": "}{"}, {bad}, {"relation":"RENVOIE","ancien":"Annexe \\"4\\"","nouveau":"x"}, {"relation":"ABRO'
    assert [growth.reference_of(x) for x in growth.complete_objects(cut)] == [{"relation": "MODIFIE", "ancien": "Article 2", "nouveau": None}, None, {"relation": "RENVOIE", "ancien": 'Annexe "4"', "nouveau": "x"}]
    assert growth.complete_objects("no array") is None and growth.complete_objects("[] [{}]") == []
    assert growth.reference_of({"relation": "MODIFIE", "ancien": "x" * 161}) is None and growth.reference_of({"relation": "MODIFIE", "ancien": 4}) is None
    assert growth.reference_of({"relation": "MODIFIE", "ancien": "a", "nouveau": "x" * 161})["nouveau"] is None


def test_reviewers_tick_only_what_is_offered():
    from quire.operators import growth

    draft = {"template_id": "d", "fields": [{"name": "a"}, {"name": "b"}, {"name": "c"}], "validation": {"required": [{"field": "a", "check": "present"}]}}
    made = growth.curate(draft, [{"field": "a", "check": "present", "severity": "reject"}], {"holder_field": "a", "issue_date_field": "b", "expiry_date_field": "c"})
    assert made["validation"]["required"][0]["severity"] == "reject" and made["attestation_reference_roles"]["holder_field"] == "a"
    for required, roles in (([{"field": "b", "check": "present"}], None), ([{"field": "a", "check": "present", "severity": "x"}], None), (None, {"holder_field": "a"}), (None, {"holder_field": "z", "issue_date_field": "b", "expiry_date_field": "c"})):
        with pytest.raises(ValueError):
            growth.curate(draft, required, roles)
    names = growth.renamed(draft, {"a": "Nom", "b": "nom", "c": ""}, lambda s: s.lower())
    assert [f["name"] for f in names["fields"]] == ["nom", "b", "c"] and names["validation"]["required"] == [{"field": "nom", "check": "present"}]
    assert growth.variant(draft | {"category": "k"}, "v", ["x"])["match"] == {"all_anchors": ["x"]}


def test_drafts_keep_varying_fields_and_no_values(spark):
    from quire.operators import growth

    docs = spark.createDataFrame([(i, f"Attestation de formation\nNom : P{i}\nVille : Paris\nDate de delivrance\n0{i}/01/2024") for i in (1, 2, 3)] + [(9, "seul")], "doc_id long, text string")
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (9, 9)], "doc_id long, cluster long")
    categories = spark.createDataFrame([(1, "attestation"), (9, "x")], "cluster long, category string")
    taken = spark.createDataFrame([("draft_attestation_01",)], "template_id string")
    made = growth.draft_templates(L.text_lines(docs), clusters, categories, taken).collect()
    assert [(r["cluster"], r["template_id"]) for r in made] == [(1, "draft_attestation_02")]
    assert made[0]["anchors"] == ["Attestation de formation", "Date de delivrance", "Ville : Paris"]
    assert [f for f in made[0]["fields"] if "pattern" in f] == ['{"name":"nom","pattern":"Nom\\\\s*:\\\\s*([^\\\\n]+)"}']
    assert any('"anchor":"Date de delivrance","direction":"below"' in f for f in made[0]["fields"])


def test_promotion_writes_both_tables(spark):
    from quire.operators import growth

    templates = spark.createDataFrame([("a", "x", False, 3, "t0")], "template_id string, category string, active boolean, version int, created_at string")
    reviews = spark.createDataFrame([(1, "pending"), (2, "pending")], "review_id long, suggestion_status string")
    curated = spark.createDataFrame([("a", "y", "t1"), ("b", "z", "t1")], "template_id string, category string, created_at string")
    after, closed = growth.promote(templates, reviews, 2, curated)
    assert sorted(map(tuple, after.collect())) == [("a", "y", True, 4, "t0"), ("b", "z", True, 1, "t1")]
    assert sorted(map(tuple, closed.collect())) == [(1, "pending"), (2, "validated")]


def test_unmatched_documents_are_summarised(spark):
    docs = spark.createDataFrame([(1, "Alpha beta. Alpha gamma! Delta?", [3], None), (2, "  ", None, [1, 2])], "doc_id long, text string, missing_pages array<int>, low_form_pages array<int>")
    made = {r["doc_id"]: r for r in retrieval.read_result(docs).collect()}
    assert made[1]["keywords"][0] == "alpha" and made[1]["chunk_count"] == 1 and "pages [3]" in made[1]["reasons"][0]
    assert made[2]["chunk_count"] == 0 and len(made[2]["reasons"]) == 2


@pytest.mark.parametrize(
    "line, want",
    [("Nom : Dupont ", ("Nom", "Dupont")), ("N: 12: x", None), ("x:: y", None), ("Tél: né: x", ("Tél", "né: x")), ("имя : x", None), ("Réf (N) :x", ("Réf (N)", "x")), ("n° (N) :x", None), ("Total:", None), ("Montant\u00a0HT\u00a0: 3", ("Montant\u00a0HT", "3"))],
)
def test_label_lines(spark, line, want):
    made = one(spark, text.colon_pair(F.lit(line)))
    assert (made and tuple(made)) == want


@pytest.mark.parametrize("line, want", [("abcd", True), ("Été1é", False), ("éàüö", True), ("12 abc 34", False), ("имена", False), ("日本語文", False)])
def test_structural_lines_have_latin_words(spark, line, want):
    assert one(spark, text.is_structural(F.lit(line))) is want


def test_check_digits_of_nested_columns(spark):
    inner = mrz.check_digit(F.lit("D23145890734"))
    assert one(spark, inner) == 9 and one(spark, mrz.check_digit(F.lit(""))) == 0
    assert one(spark, mrz.check_digit(F.concat(F.lit("D23145890734"), inner.cast("string")))) == (9 + 9 * 7) % 10
    assert one(spark, mrz.check_digit(F.lit(None).cast("string"))) is None


def test_zone_lines_follow_the_page(spark):
    zone = "IDFRADUPONT<<<<<<<<<<<<<<<<<<"
    rows = [(1, 0, "b" + zone[1:], 50.0), (1, 1, zone.lower().replace("<", ">"), 10.0), (1, 2, "NOT A ZONE LINE AT ALL BUT LONG", 0.0), (2, 0, zone, 0.0), (3, 0, "A" * 30, 0.0), (3, 1, zone, 1.0), (4, 1, zone[:-1] + "2", 5.0), (4, 0, zone[:-1] + "1", 5.0)]
    made = {r["doc_id"]: r["zone"] for r in mrz.zone_lines(spark.createDataFrame(rows, "doc_id long, line_no int, text string, y0 double")).collect()}
    assert made == {1: [zone, "B" + zone[1:]], 4: [zone[:-1] + "1", zone[:-1] + "2"]}


@pytest.mark.parametrize("capacity", [1, 3, 1024])
def test_replays_are_remembered_for_a_while(spark, capacity):
    rnd = random.Random(5)
    rows = [(i % 3, i, f"r{rnd.randrange(9)}" if rnd.random() < 0.9 else None) for i in range(400)]
    want, kept = {}, {}
    for host, seq, request in rows:
        own = kept.setdefault(host, [])
        want[seq] = request in own
        if request not in own:
            own.append(request)
            del own[:-capacity]
    made = store.replayed(spark.createDataFrame(rows, "host long, seq long, request_id string"), capacity=capacity)
    assert {r["seq"]: r["replay"] for r in made.collect()} == want


def test_admission_keeps_to_the_limit(spark):
    rnd = random.Random(6)
    rows = [(i, i % 2, (s := rnd.randrange(300)), s + rnd.randrange(1, 40)) for i in range(300)]
    want, running = {}, {}
    for call, host, start, end in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        own = [e for e in running.get(host, []) if e > start]
        want[call] = len(own) < 2
        running[host] = own + [end] * want[call]
    made = lifecycle.concurrency(spark.createDataFrame(rows, "call_id long, host long, start long, end long"), 2)
    assert {r["call_id"]: r["admitted"] for r in made.collect()} == want


def test_batches_close_before_the_budget(spark):
    rows = [(1, "a", 0, 1500), (2, "a", 1, 500), (3, "a", 2, 1), (4, "a", 3, 5000), (5, "a", 4, 1), (6, "b", 0, 9999), (7, None, 0, 1)]
    made = {r["doc_id"]: r["batch_no"] for r in retrieval.token_batches(spark.createDataFrame(rows, "doc_id long, group string, pos int, tokens int")).collect()}
    assert made == {1: 0, 2: 0, 3: 1, 4: 2, 5: 3, 6: 0, 7: 0}


def test_cards_at_door_and_worker(spark):
    schema = "status string, verdict string, record_reasons array<string>, reasons array<string>, missing array<string>, job_reasons array<string>, verso_read_path string"
    rows = [("complete", "auto", ["r"], ["s"], [], ["j"], "raw"), ("complete", None, ["r"], ["s"], [], ["j"], None), ("incomplete", None, [], ["please"], ["verso"], [], None)]
    records = flow.ci_records(spark.createDataFrame(rows, schema))
    door = [(r["outcome"], r["job_status"], r["wire"], r["wire_verdict"], r["http"], r["trace"]) for r in flow.door_edge(records).collect()]
    assert door == [("auto", "done", "validated", "auto", 200, ["r"]), ("review", "received", "pending", None, 202, ["s"]), ("review", "done", "incomplete", None, 200, ["please", "missing side(s): verso"])]
    worker = [(r["job_status"], r["written"]) for r in flow.worker_edge(records).collect()]
    assert worker == [("done", ["j", "r", "verso read via: raw"]), ("needs_review", ["j", "s"]), ("needs_review", ["please"])]


def test_summaries_inside_a_document(spark):
    docs = spark.createDataFrame([(1, "Alpha beta. Beta gamma! X. Delta?  Beta beta beta"), (2, ""), (3, None), (3, "une une deux trois")], "doc_id long, text string")
    words = sorted((r["doc_id"], r["rank"], r["term"], r["n"]) for r in retrieval.keywords(docs, k=2).collect())
    assert words == [(1, 1, "beta", 5), (1, 2, "alpha", 1), (3, 1, "deux", 1), (3, 2, "trois", 1)]
    best = [(r["sentence_no"], r["sentence"], r["score"]) for r in retrieval.key_sentences(docs.where("doc_id = 1"), k=2).collect()]
    assert best == [(0, "Alpha beta.", 3.0), (4, "Beta beta beta", 5.0)] or best == [(0, "Alpha beta.", 3.0), (3, "Beta beta beta", 5.0)]


@pytest.mark.parametrize("block", [4, 1024])
def test_similar_pairs_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(drafting, "BLOCK", block)
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("alpha beta gamma delta kappa sigma omega theta".split()) for _ in range(rnd.randrange(1, 7)))) for i in range(40)] + [(90, ""), (91, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {i: collections.Counter((t or "").split()) for i, t in rows}
    df = collections.Counter(w for c in counts.values() for w in c)
    vectors = {}
    for i, c in counts.items():
        raw = {w: n * (math.log((len(rows) + 1) / (df[w] + 1)) + 1) for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        vectors[i] = {w: x / norm for w, x in raw.items()}
    want = {(a, b): round(s, 9) for a in vectors for b in vectors if a < b and (s := sum(x * vectors[b].get(w, 0) for w, x in vectors[a].items())) >= 0.5}
    made = {(r["a"], r["b"]): round(r["score"], 9) for r in drafting.pairwise_similarity(docs).collect()}
    assert made == want


def test_overflow_actions_and_json_columns(spark):
    one = spark.createDataFrame([("reject_503",), ("reject",), ("defer",), (None,)], "v string")
    assert [r[0] for r in one.select(flow.setting(F.col("v"), "overflow", "defer")).collect()] == ["reject_503", "defer", "defer", "defer"]
    texts = spark.createDataFrame([(None,), ("",), ('{"a": null, "b": "1"}',)], "v string")
    assert [r[0] for r in texts.select(store.decoded(F.col("v"), "map<string,string>")).collect()] == [{}, {}, {"a": None, "b": "1"}]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        spark.createDataFrame([("{",)], "v string").select(store.decoded(F.col("v"), "map<string,string>")).collect()
    with pytest.raises(ValueError):
        store.issue_key(spark, "desk", "other")


def test_drafts_suggest_checks_that_hold_everywhere(spark):
    from quire.operators import growth

    rows = [(1, d, n, name, v) for d, *vs in [(1, "01/02/2020", "01/02/2023", "A1"), (2, "2021-03-01", "2024-03-02", "A1")] for n, (name, v) in enumerate(zip(("du", "au", "code"), vs, strict=True))]
    rows += [(2, d, 0, "nom", f"Nom {d}") for d in (3, 4)]
    schema = "cluster long, doc_id long, label_no int, name string, value string"
    made = {r["cluster"]: r for r in growth.value_checks(spark.createDataFrame(rows, schema)).collect()}
    assert set(made) == {1} and made[1]["dated"] == {"du": True, "au": True}
    assert [(r["check"], r["first"], r["second"], r["years"], r["allowed"]) for r in made[1]["rules"]] == [
        ("date_order", "du", "au", None, None),
        ("date_span", "du", "au", 3, None),
        ("vocabulary", "code", None, None, ["A1"]),
    ]
    assert growth.value_checks(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("dense", [0, 30, 10**9])
def test_similar_pairs_by_products_and_by_words(spark, monkeypatch, dense):
    for name, value in (("DENSE", dense), ("COLUMNS", 3), ("ROWS", 2), ("MEETINGS", 3), ("OUT", 2), ("LETTERS", 300)):
        monkeypatch.setattr(drafting, name, value)
    rnd = random.Random(5)
    words = [f"wort{i}" for i in range(30)]
    rows = [(i, " ".join(rnd.choices(words, weights=[1 / (k + 1) for k in range(30)], k=rnd.randrange(1, 12)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {i: collections.Counter(t.split()) for i, t in rows}
    df = collections.Counter(w for c in counts.values() for w in c)
    raw = {i: {w: n * (math.log((len(rows) + 1) / (df[w] + 1)) + 1) for w, n in c.items()} for i, c in counts.items()}
    vectors = {i: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for i, v in raw.items()}
    want = {(a, b): round(s, 9) for a in vectors for b in vectors if a < b and (s := sum(x * vectors[b].get(w, 0) for w, x in vectors[a].items())) >= 0.5}
    made = [(r["a"], r["b"], round(r["score"], 9)) for r in drafting.pairwise_similarity(docs).collect()]
    assert len(made) == len(want) and {(a, b): s for a, b, s in made} == want


def test_greedy_clusters_deal_their_edges_once(spark, monkeypatch):
    plans, kept = [], drafting.kept
    monkeypatch.setattr(drafting, "kept", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    edges = {(i, i + 1) for i in range(0, 30, 3)} | {(i, i + 3) for i in range(0, 27, 3)}
    docs = spark.range(32).select(F.col("id").alias("doc_id"))
    made = drafting.greedy_clusters(docs, spark.createDataFrame(sorted(edges) * 2, "a long, b long"))
    assert {r["doc_id"]: r["cluster"] for r in made.collect()} == plain_clusters(range(32), edges)
    assert len(plans) > 2 and all("InMemoryRelation" in p for p in plans[1:]) and "Aggregate" not in plans[0]


def test_similar_pairs_are_compared_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(drafting, "BLOCK", 3)
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.concat(F.lit("alpha beta wort"), (F.col("id") % 4).cast("string")).alias("text"))
    pairs = drafting.pairwise_similarity(docs)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert pairs.count() == 8


@pytest.mark.parametrize("block", [3, 8192])
def test_similar_documents_cluster_without_stored_pairs(spark, monkeypatch, block):
    from quire.plans import catalog

    monkeypatch.setattr(drafting, "BLOCK", block)
    rnd = random.Random(11)
    rows = [(3 * i - 20, " ".join(rnd.choice("alpha beta gamma delta kappa sigma omega theta".split()) for _ in range(rnd.randrange(1, 6)))) for i in range(40)] + [(-90, ""), (50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    edges = {(r["a"], r["b"]) for r in drafting.pairwise_similarity(docs).collect()}
    monkeypatch.setattr(drafting, "pairwise_similarity", None)
    monkeypatch.setattr(catalog, "_unknown", lambda spark, folder: docs)
    made = catalog.QUERIES["cluster_greedy"](spark, "").collect()
    assert len(made) == len(rows) and {r["doc_id"]: r["cluster"] for r in made} == plain_clusters([i for i, _ in rows], edges)
    assert drafting.similar_clusters(docs.where("text = ''")).collect() == [(-90, -90)]


def test_near_lines_of_a_batch(monkeypatch):
    monkeypatch.setattr(match, "AT_ONCE", 60)
    rnd = random.Random(4)
    for size in (1, 3, 4, 7, 9, 70, 260):
        needle = "".join(rnd.choice("abcdé") for _ in range(size))
        lines = ["", needle, needle[1:] + "b", "a" + needle[: size // 2], "bb" + needle[: size // 2] + "x" * (size // 7) + needle[size // 2 + size // 7 :]]
        lines += ["".join(rnd.choice("abcdé") for _ in range(rnd.randrange(30))) for _ in range(20)]
        slips = lambda line: size >= 4 and any(difflib.SequenceMatcher(None, needle, line[i : i + n]).ratio() >= 0.75 for n in range(size - 1, size + 2) for i in range(len(line) - n + 1))  # noqa: E731, B023
        assert match.near_lines(needle, lines).tolist() == [needle in line or slips(line) for line in lines]


def test_names_of_all_clusters_in_one_pass(spark, monkeypatch):
    slugs = {1: ["nom", "nom", "nom_2", "nom", "nom_2"], 2: ["nom", "date", "nom"], 3: ["nom_2", "nom", "nom"], 4: ["a"] * 12}
    rows = [(c, i, s) for c, names in slugs.items() for i, s in enumerate(names)]
    labels = spark.createDataFrame(rows, "cluster long, label_no int, label string")
    made = drafting.unique_names(labels)
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    names = {}
    for r in made.orderBy("cluster", "label_no").collect():
        names.setdefault(r["cluster"], []).append(r["name"])
    assert names == {1: ["nom", "nom_2", "nom_2_2", "nom_3", "nom_2_3"], 2: ["nom", "date", "nom_2"], 3: ["nom_2", "nom", "nom_3"], 4: ["a"] + [f"a_{i}" for i in range(2, 13)]}
