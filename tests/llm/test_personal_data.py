"""Operator 11: base spans against the contract's patterns, bootstrapping against plain sets."""

import collections
import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from quarry.llm import personal_data as pii
from quarry.llm.queries import REGISTRY

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def check_sum(digits):
    table = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(table[int(c)] if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0


def by_contract(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and check_sum(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(found)


def test_base_spans_against_the_patterns():
    rng = random.Random(11)
    for alphabet, size in (("ab.@-_1", 40), ("0129.. ", 60), ("07 -.", 50), ("+19() -.", 60), ("a1.@+ -9(é", 80)):
        for _ in range(3000):
            text = "".join(rng.choices(alphabet, k=rng.randrange(size)))
            assert pii.base_spans(text) == by_contract(text), text
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1112", "30569309025904", "6304 0000 0000 0000 000"]
    assert [bool(pii.base_spans(f"a {c} b")) for c in cards] == [bool(by_contract(f"a {c} b")) for c in cards] == [True, False, True, True]


def test_long_texts_take_linear_time():
    began = time.time()
    for text in ("a" * 2_000_000, "1" * 1_000_000, "1." * 500_000, "+1" * 500_000, "a@" * 500_000, "1 " * 500_000,
                 "+1" + "-" * 1_000_000, "x@y." * 250_000, "a.b-c_" * 300_000 + "@"):
        pii.base_spans(text)
        list(pii._others(text, []))
    assert time.time() - began < 60


def brute_force(texts):
    """Spans of each text, with everything in plain sets."""
    base = [by_contract(t) for t in texts]
    places, kind_of = [], {}
    for n, text in enumerate(texts):
        for s, r, e in base[n]:
            places.append((n, s, e, text[s:e].lower(), pii.patterns(text, s, e), True))
            if places[-1][4]:
                kind_of[text[s:e].lower()] = min(r, kind_of.get(text[s:e].lower(), 9))
        places += [(n, s, e, text[s:e].lower(), pii.patterns(text, s, e), False) for s, e in pii._others(text, pii._union(base[n]))]
    edges = collections.defaultdict(set)
    for _, _, _, instance, own, _ in places:
        for p in own:
            edges[p].add(instance)

    def used():
        out = {}
        for p, instances in edges.items():
            counts = collections.Counter(kind_of[i] for i in instances if i in kind_of)
            if counts:
                kind = min(counts, key=lambda k: (-counts[k], k))
                known = sum(counts.values())
                confidence = counts[kind] / (known + pii.UNKNOWN * (len(instances) - known) + 1)
                if counts[kind] >= pii.SUPPORT and confidence >= pii.PATTERN:
                    out[p] = (kind, confidence)
        return out

    found = {}
    for _ in range(pii.ROUNDS):
        miss = collections.defaultdict(lambda: 1.0)
        for p, (kind, confidence) in used().items():
            for i in edges[p] - kind_of.keys():
                miss[i, kind] *= 1 - confidence
        new = {}
        for (i, kind), m in sorted(miss.items(), key=lambda x: (x[1], x[0][1])):
            if 1 - m >= pii.INSTANCE:
                new.setdefault(i, kind)
        if not new:
            break
        kind_of.update(new)
        found.update(new)
    good = used()
    spans = [[(s, pii.KINDS[r], e, r) for s, r, e in b] for b in base]
    for n, s, e, instance, own, seed in places:
        if not seed and instance in found and any(good.get(p, (None,))[0] == found[instance] for p in own):
            spans[n].append((s, f"ctx_{pii.KINDS[found[instance]]}", e, 4 + found[instance]))
    return [",".join(f"{k}:{s}:{e}" for s, k, e, r in sorted(own, key=lambda x: (x[0], x[3]))) for own in spans]


def letters():
    """Phones and mails with the contexts that people write, numbers nobody should find."""
    rng = random.Random(7)
    texts = []
    for i in range(60):
        texts += [f"Please call me at +1 (555) 010-{1000 + i} after noon", f"reach us: mail to user{i}@site{i % 7}.example.org now"]
    for i in range(25):
        texts.append(f"Hello there, call me at 0{rng.randrange(10**8, 10**9)} after lunch or later")
        texts.append(f"Order number {rng.randrange(10**6, 10**7)} was sent")
    # a second round: contexts that only the discovered ones share
    number = [f"020 {7000 + i} {1000 + i}" for i in range(30)]
    texts += [f"you can call me at {n} after six" for n in number] + [f"desk line is {n} inside the house" for n in number]
    texts += [f"desk line is {i}00 443 99{i:02d} inside the house" for i in range(4)]
    texts += [f"call me at {y} sharp" for y in (2024, 12345)] * 3
    return texts + texts[:1] * 40 + ["", None, "call me at", "no digits at all", "İ +1 555 010 9999 ß call me at 77123456 after"]


def test_bootstrapping_against_plain_sets(spark):
    texts = letters()
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, kind string, start int")
    rows = {r.doc_id: r for r in pii.personal_spans(table.repartition(4)).collect()}
    want = brute_force([t or "" for t in texts])
    assert [rows[i].spans for i in range(len(texts))] == want
    assert any("ctx_phone" in s for s in want) and rows[texts.index("desk line is 200 443 9902 inside the house")].n_added == 1
    assert not any(rows[i].n_added for i, t in enumerate(texts) if t and t.startswith("Order"))
    for i, t in enumerate(texts):
        base = by_contract(t or "")
        assert [rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone] == [sum(r == k for _, r, _ in base) for k in range(4)]
        written = ",".join(f"{pii.KINDS[r]}:{s}:{e}" for s, r, e in base)
        assert rows[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest()
    assert math.isclose(rows[0].n_phone, 1)


def test_hard_cases(docs, none, spark):
    rows = pii.personal_spans(docs).collect()
    assert len(rows) == docs.count() and not any(r.n_added or r.n_email or r.n_card for r in rows)
    assert pii.personal_spans(none).count() == 0
    spans = pii.personal_data(spark.createDataFrame([(None, "me@x.org"), (None, "me@x.org")], "doc_id long, text string"))
    assert [[tuple(s) for s in r.base] for r in spans.collect()] == [[(0, 0, 8, "email")]] * 2
    assert spans.where(F.size("added") > 0).count() == 0


def test_query_against_the_patterns(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = REGISTRY["op11_personal_data"](spark, sf).collect()
    assert len(rows) == len(texts)
    want = brute_force([texts[r.doc_id] for r in rows])
    assert [r.spans for r in rows] == want
