"""Personal information: held-out accuracy on texts made here, redaction, edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.llm.mentions import FEATURES, Generator
from tracewell.llm.personal import Scorer, find_personal, redact

GIVEN = ["Petra", "Hugo", "Amara", "Stefan", "Lena", "Marek", "Ruben", "Zora", "Noor", "Iris"]
FAMILY = [a + b for a in ("Yold", "Kesw", "Tolv", "Brack", "Fenn", "Corv") for b in ("mund", "ingale", "enko", "marsh", "ette")]


def mentions(rng):
    g, f = rng.choice(GIVEN), rng.choice(FAMILY)
    n = rng.randrange(100, 999)
    name = rng.choice([f"{g} {f}", f"{f}, {g}", f"{g} van {f}", f"{g} B. {f}"])
    mail = rng.choice([f"{g.lower()}.{f.lower()}@mail.example.net", f"{f.lower()}{n} (at) example.org"])
    phone = rng.choice([f"+1 {n}-555-0{n}", f"07700 900{n}", f"({n}) 555-0{n}"])
    number = rng.choice([f"9{n % 100:02d}-{n % 90 + 10}-{n}4", f"0{n} {n}1 4{n}", f"QQ{n}{n}A"])
    street = rng.choice([f"{n % 240 + 1} Birken Road", f"Kesselweg {n % 240 + 1}a", f"{n % 99 + 1}, rue des Tilleuls", f"Calle Olmo Viejo, {n % 99 + 1}"])
    return {"name": name, "email": mail, "phone": phone, "id_number": number, "address": street}


@pytest.fixture(scope="module")
def result(spark):
    rng = random.Random(3)
    rows, truth = [], {}
    for i in range(500):
        m = mentions(rng)
        text = (
            f"Please check the shard and the dataset runner. Reviewed by {m['name']}; phone {m['phone']}\nIris Dataset and Hugo Runner passed, build 2024-0311-5550, SKU 98-765-{1000 + i}\n"
            f"it took {i % 40 + 2} more way to settle and {i % 9 + 3} other place of the shard moved\nssn={m['id_number']} leaked; deliver to {m['address']} and write to {m['email']} about icon@2x.png, git@forge.example:a/b.git, toolbelt@4.12.0"
        )
        rows.append(("t", str(i), text))
        truth["t", str(i)] = {(k, v) for k, v in m.items()}
    rows += [("t", "0", rows[0][2]), ("t", "null", None), ("t", "empty", ""), ("t", None, rows[0][2]), ("t", "plain", "nothing to see here " * 20_000)]
    records = spark.createDataFrame(rows, "table_name string, key string, content string")
    names = spark.createDataFrame([(g,) for g in GIVEN[:8]], "given_name string")
    spans = find_personal(records, names)
    return records, truth, {(r.table_name, r.key): r.spans for r in spans.collect()}, spans


@pytest.mark.parametrize("kind", ["name", "email", "phone", "id_number", "address"])
def test_accuracy(result, kind):
    _, truth, found, _ = result
    right = {(k, v) for k, t in truth.items() for x, v in t if x == kind}
    got = {(k, s.value) for k, spans in found.items() for s in spans if s.kind == kind}
    assert len(right & got) >= 0.95 * len(right)
    assert len(right & got) >= 0.95 * len(got)


def test_statistics_of_any_size_give_the_same(spark, result):
    records, _, found, _ = result
    names = spark.createDataFrame([(g,) for g in GIVEN[:8]], "given_name string")
    parts = {(r.table_name, r.key): sorted((s.a, s.b, s.kind) for s in r.spans) for r in find_personal(records, names, entries=0).collect()}
    assert parts == {k: sorted((s.a, s.b, s.kind) for s in spans) for k, spans in found.items()}


def test_places_and_edges(result):
    records, _, found, _ = result
    texts = {(r.table_name, r.key): r.content for r in records.collect()}
    assert set(found) <= {k for k in texts if k[1] not in (None, "null", "empty", "plain")}
    for k, spans in found.items():
        assert all(texts[k][s.a : s.b] == s.value for s in spans)
        assert all(x.b <= y.a for x, y in zip(spans, spans[1:], strict=False))


def test_redaction_keeps_the_rest(result):
    records, _, found, spans = result
    for r in redact(records, spans).collect():
        if (r.table_name, r.key) in found and r.key is not None:
            assert "[NAME]" in r.content and "Reviewed by" in r.content
        elif r.key == "null":
            assert r.content is None


def test_empty_table(spark):
    empty = spark.createDataFrame([], "table_name string, key string, content string")
    names = spark.createDataFrame([], "given_name string")
    assert find_personal(empty, names).count() == 0


def test_all_labelled_candidates_count(spark):
    def rows(n, kind, **features):
        values = F.array(*[F.lit(float(features.get(f, f == kind))) for f in FEATURES])
        every = spark.range(n).select(F.lit("t").alias("table_name"), F.col("id").cast("string").alias("key"), F.lit(0).alias("a"), F.lit(9).alias("b"), F.lit(kind).alias("kind"), F.lit(str(features)).alias("value"))
        return every.withColumns({"features": values, "h": F.xxhash64("value", "kind", "table_name", "key", "a")})

    common = rows(14_000, "email", form=1).union(rows(14_000, "email")).filter("h < 0")  # some 14,000 in front, if candidates are cut by their hash
    rare = rows(60, "id_number", form=1, cue=1).union(rows(60, "id_number", form=1, cue_not=1)).filter("h > 0")
    scorer = Scorer(common.union(rare).drop("h"))
    kept = {(r.kind, r.value) for r in scorer.keep(rare.drop("h")).collect()}
    assert kept == {("id_number", "{'form': 1, 'cue': 1}")}


def test_an_end_of_a_word_is_no_context():
    generate = Generator(set(), {}, {}, {})
    not_a_person = [f[FEATURES.index("cue_not")] for text in ("Ulfmund, Gustav | +13125550186", "lib v +13125550186", "old_version: +13125550186") for *_, f in generate(text)]
    assert not_a_person == [0, 0, 1, 1, 1, 1]
