"""Mixing, exact deduplication and pseudonyms."""

import hashlib
from collections import Counter

import duckdb
import pytest

from tessera.llm import exact_dedup, mixing, pii


def test_exact_groups_odd_rows(odd):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_groups(odd).collect()}
    assert exact_dedup.exact_groups(odd).count() == odd.count()
    same = hashlib.sha256(b"the same words stand here twice over").hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[1, same].keep_id, got[1, same].group_size, got[1, same].kept) == (2, 3, False)
    assert got[2, same].kept
    assert (got[3, empty].keep_id, got[4, empty].keep_id, got[3, empty].group_size) == (4, 4, 2)


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_a_full_filter_changes_nothing(spark, bits):
    rows = [(i, f"t{i % 40}") for i in range(200)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), max_bits=bits).collect()
    assert all(r.group_size == 5 and r.keep_id == 160 + r.doc_id % 40 for r in got) and len(got) == 200


def test_drop_exact_keeps_one_row_of_each_text(odd, none):
    kept = exact_dedup.drop_exact(odd)
    assert kept.columns == odd.columns
    texts = Counter(r.text or "" for r in kept.collect())
    assert set(texts.values()) == {1} and len(texts) == 6
    assert exact_dedup.drop_exact(none).count() == 0


def brute_targets(sizes):
    """Reshare what is above three times a source's size until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        share = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        above = [s for s in free if share * weight[s] > 3 * sizes[s]]
        if not above:
            return fixed | {s: share * weight[s] for s in free}
        fixed |= {s: 3 * sizes[s] for s in above}


def test_targets_against_brute_force(spark):
    sizes = {"a": 500, "b": 3, "c": 40, "d": 0, None: 90, "é": 7}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = brute_targets(sizes)
    for r in plan:
        assert r.mix.source_size == sizes[r.source]
        assert r.mix.target == pytest.approx(want[r.source])
        assert r.mix.taken <= 3 * r.mix.size


def test_mix_meets_targets_and_repeats(spark):
    rows = [(i, "w " * (5 + i % 11), f"s{i % 7 if i % 3 else 0}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = [r.mix for r in mixing.mix_plan(docs).collect()]
    taken, target = Counter(), {}
    for r, m in zip(mixing.mix_plan(docs).collect(), plan, strict=True):
        assert r.mix == m
        taken[r.source] += m.taken
        target[r.source] = m.target
    assert all(abs(taken[s] - t) < 0.08 * t for s, t in target.items())
    assert mixing.mix(docs).count() == sum(m.copies for m in plan)


def test_mix_odd_rows(odd, none):
    plan = mixing.mix_plan(odd)
    assert plan.columns == [*odd.columns, "mix_"] and plan.count() == odd.count()
    assert {r.doc_id: r["mix_"].size for r in plan.collect()}[3] == 0
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix_plan(none).count() == 0


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_pseudonyms(spark, odd, none):
    text = (
        "a 4111 1111 1111 1111 b 4111111111111111, 5731080387325255 x +1 (017) 555-7713. 233.233.171.252 y 300.1.1.1 "
        "best.54@mail3.example.com! 2024-02-29 29/02/2023 01.03.1999 123-45-6789 666-12-3456 v4.0."
    )
    docs = spark.createDataFrame([(1, text), (2, "again 4111111111111111"), (3, "4111-1111-1111-1112")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    made = {x.original: x for x in rows[1].replaced}
    assert Counter(x.kind for x in rows[1].replaced) == {"card": 2, "phone": 1, "ip": 1, "email": 1, "date": 2, "ssn": 1}
    card = made["4111111111111111"].pseudonym
    assert luhn(card) and card[0] == "4" and card != "4111111111111111"
    assert made["4111 1111 1111 1111"].pseudonym.replace(" ", "") == card and rows[2].replaced[0].pseudonym == card
    assert rows[3].text == "4111-1111-1111-1112"
    for left in ("5731080387325255", "300.1.1.1", "29/02/2023", "666-12-3456", "v4.0."):
        assert left in rows[1].text
    assert all(o not in rows[1].text for o in made)
    assert duckdb.sql(f"select date '{made['2024-02-29'].pseudonym}'").fetchall()
    assert all(0 <= int(o) <= 255 for o in made["233.233.171.252"].pseudonym.split("."))
    out = pii.pseudonymise(odd, "k")
    assert out.columns == [*odd.columns, "replaced_"] and out.count() == odd.count()
    assert {(r.doc_id, r.text) for r in out.collect()} == {(r.doc_id, r.text) for r in odd.collect()}
    assert pii.pseudonymise(none, "k").count() == 0


def rest_97(iban):
    flat = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97


def test_pseudonyms_of_further_kinds(spark):
    text = (
        "call (555) 223-4567 or 555-223-4567 not 155-223-4567; amex 3782 822463 10005 and 3782-822463-10005; 12/25/1990, 25/12/1990, 1815-06-18; "
        "GB29 NWBK 6016 1331 9268 19 and DE89370400440532013000 not DE88370400440532013000; na\u00efve@ex.com"
    )
    got = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    made = {x.original: x for x in got.replaced}
    assert Counter(x.kind for x in got.replaced) == {"phone": 2, "card": 2, "date": 3, "iban": 2, "email": 1}
    national = made["555-223-4567"].pseudonym
    assert made["(555) 223-4567"].pseudonym == f"({national[:3]}) {national[4:]}" and national[0] > "1" and national[4] > "1"
    amex = made["3782 822463 10005"].pseudonym
    assert luhn(amex.replace(" ", "")) and [len(x) for x in amex.split(" ")] == [4, 6, 5] and made["3782-822463-10005"].pseudonym == amex.replace(" ", "-")
    for iban in ("GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000"):
        new = made[iban].pseudonym
        assert rest_97(new) == 1 and new[:2] == iban[:2] and len(new) == len(iban) and new != iban
    assert "NWBK" in made["GB29 NWBK 6016 1331 9268 19"].pseudonym and "DE88370400440532013000" in got.text and "155-223-4567" in got.text
    assert 1000 <= int(made["1815-06-18"].pseudonym[:4]) < 1900 <= int(made["12/25/1990"].pseudonym[6:])
    assert "na\u00efve" not in got.text


@pytest.mark.parametrize("text", ["a@" + "b." * 500_000 + "1", "a1b2" * 250_000, "4111 " * 60_000, "1." * 500_000, "x@" * 500_000, "+1 (" * 250_000, "AB12 " * 100_000, "\u00e9." * 500_000 + "@"])
def test_pseudonyms_of_long_texts(spark, text):
    import time

    start = time.time()
    got = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").select("text").first()
    assert got.text == text and time.time() - start < 30


def plain_pseudonyms(text, key):
    """The operator once more, in Python: (text, pairs of kind and pseudonym)."""
    from datetime import date, timedelta

    import regex

    def feistel(label, left, right, a, b):
        for n in range(pii.ROUNDS):
            f = int(hashlib.sha256(f"{key}:{label}:{n}:{right if n % 2 == 0 else left}".encode()).hexdigest()[:15], 16)
            left, right = ((left + f) % a, right) if n % 2 == 0 else (left, (right + f) % b)
        return left, right

    def digits(label, d):
        h = len(d) // 2
        left, right = feistel(label, int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h))
        return f"{left:0{h}}{right:0{len(d) - h}}"

    def into(mask, made):
        made = iter(made)
        return "".join(c if c in " -.()+" else next(made) for c in mask)

    def check(body):
        return next(d for d in "0123456789" if luhn(body + d))

    def day(y, m, d):
        try:
            return date(int(y), int(m), int(d))
        except ValueError:
            return None

    def card(m):
        d = regex.sub("[ -]", "", m)
        if luhn(d):
            body = d[0] + digits("card", d[1:-1])
            return into(m, body + check(body))

    def phone(m):
        d = regex.sub("[^0-9]", "", m)
        if not m.startswith("+"):
            left, right = feistel("national", (int(d[:3]) - 200) * 800 + int(d[3:6]) - 200, int(d[6:]), 640_000, 10_000)
            return into(m, f"{left // 800 + 200}{left % 800 + 200}{right:04}")
        new, place = iter(digits("phone", d[-10:])), len(d) - 10
        out = ""
        for c in m:
            place -= c.isdigit()
            out += next(new) if c.isdigit() and place < 0 else c
        return out

    def ip(m):
        o = [int(x) for x in m.split(".")]
        if max(o) < 256:
            left, right = feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
            return f"{left >> 8}.{left % 256}.{right >> 8}.{right % 256}"

    def dates(m):
        iso, first = m[4] == "-", None
        if iso:
            on = day(*m.split("-"))
        else:
            first = day(m[6:], m[3:5], m[:2])
            on = first or (day(m[6:], m[:2], m[3:5]) if m[2] == "/" else None)
        for start, root in pii.DATES if on else ():
            n = (on - date.fromisoformat(start)).days
            if 0 <= n < root * root:
                left, right = feistel(f"date {start}", n // root, n % root, root, root)
                y, mo, d = (date.fromisoformat(start) + timedelta(left * root + right)).isoformat().split("-")
                return f"{y}-{mo}-{d}" if iso else m[2].join([d, mo, y] if first else [mo, d, y])

    def ssn(m):
        area, group, serial = (int(x) for x in m.split("-"))
        if 0 < area < 900 and area != 666 and group and serial:
            areas = [x for x in range(1, 900) if x != 666]
            left, right = feistel("ssn", areas.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999)
            return f"{areas[left // 99]:03}-{left % 99 + 1:02}-{right + 1:04}"

    def iban(m):
        flat = m.replace(" ", "")
        d = regex.sub("[A-Z]", "", flat[4:])
        if 15 <= len(flat) <= 34 and rest_97(flat) == 1 and len(d) > 1:
            new = iter(digits("iban", d))
            account = "".join(next(new) if c.isdigit() else c for c in flat[4:])
            rest = next(f"{k:02}" for k in range(2, 99) if rest_97(f"{flat[:2]}{k:02}{account}") == 1)
            return into(m, flat[:2] + rest + account)

    def email(m):
        host = m.rpartition("@")[2]
        local, at = (hashlib.sha256(f"{key}:{k}:{x.lower()}".encode()).hexdigest()[:16] for k, x in (("local", m), ("host", host)))
        return f"p{local}@h{at}.{host.rpartition('.')[2]}"

    makers = {"email": email, "ip": ip, "date": dates, "ssn": ssn, "iban": iban, "phone": phone, "card": card}
    found = []

    def replace(match):
        m = match[0]
        kind = next(k for k, p in pii.PATTERNS.items() if regex.fullmatch(p, m))
        if (new := makers[kind](m)) is not None:
            found.append((kind, new))
        return m if new is None else new

    return regex.sub(pii.ANY, replace, text), found


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_plain_pseudonyms(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    kinds = Counter()
    for r in pii.op10_pseudonymise(spark, sf).collect():
        text, found = plain_pseudonyms(texts[r.doc_id] or "", pii.TEST_KEY)
        count = Counter(k for k, _ in found)
        assert (r.text or "", r.n_replaced) == (text, len(found)) and all(r[f"n_{k}"] == count[k] for k in pii.PATTERNS)
        kinds += count
    assert len(kinds) >= 4


def test_feistel_permutes(spark):
    from pyspark.sql import functions as F

    df = spark.range(27 * 31).select((F.col("id") / 31).cast("long").alias("l"), (F.col("id") % 31).alias("r"))
    out = df.select(pii.feistel("k", "x", F.col("l"), F.col("r"), F.lit(27), F.lit(31)).alias("p"))
    assert out.distinct().count() == 27 * 31


def test_queries_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    for module, f in ((mixing, mixing.op1_mix_sources), (exact_dedup, exact_dedup.op9_exact_dedup)):
        got = f(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
        want = con.execute(module.SQL).df().sort_values("doc_id").reset_index(drop=True)[list(got.columns)]
        for c in got.columns:
            assert (got[c] == want[c]).all() or abs(got[c] - want[c]).max() < 1e-6
