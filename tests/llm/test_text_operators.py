"""The text operators against brute-force versions, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import _text, chat, decontaminate, html_extract, license_scan, line_dedup, ngram_join, packing, quality, queries, sketch, surrogates
from quillon.llm.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    """Documents with some columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", None if t is None else len(t), 1, "x") for i, t in (x if isinstance(x, tuple) else (k, x) for k, x in enumerate(texts))]
    return spark.createDataFrame(rows, DOCS + ", component_id long, score string")


def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def collected(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


EDGES = [None, "", " \n\t ", "one", "the same text twice", "the same text twice", "x " * 30000]
PROSE = [" ".join(random.Random(i).choices("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split(), k=80)) for i in range(8)]


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"pipeline"}))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_hashes_follow_content():
    a, at = _text.joined([b"Alpha beta", b"alpha BETA alpha", b""])
    s, e = _text.word_spans(a, _text.WHITE)
    h = _text.segment_hashes(a, s, e)
    assert len(h) == 5 and h[0] == h[2] == h[4] and h[1] == h[3] and h[0] != h[1]


# op1
def base_scan(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    at = [(i, label) for phrase, label in license_scan.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_license_scan(spark):
    extra = ["MIT  License; mit-license!", "Apache License, Version 2.0. GENERAL PUBLIC\nLICENSE", "mit licensee", "Licensed under CC BY-NC 4.0.", "É mit license x"]
    d = real(spark).select("doc_id", "text").unionByName(docs(spark, [(10**6 + i, t) for i, t in enumerate(EDGES + extra)]).select("doc_id", "text"))
    texts = dict(collected(d))
    got = license_scan.license_scan(d).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:6] == base_scan(texts[r["doc_id"]]), r["doc_id"]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in got}
    assert "apache-2.0" in by[10**6 + 8]["labels"] or by[10**6 + 8]["score"] == 0.5
    assert by[10**6 + 10]["labels"] == "cc-by-nc-4.0" and by[10**6 + 10]["score"] == 1


def test_license_scan_finds_all_notices_of_a_file():
    notices = [n for _, n, _ in license_scan.NOTICES]
    rng = random.Random(5)

    def brute(text):
        w, out = text.split(), set()
        for label, notice, keys in license_scan.NOTICES:
            n = notice.split()
            places = [(k.split(), next(p for p in range(len(n)) if n[p : p + len(k.split())] == k.split())) for k in keys]
            for at in range(-len(n), len(w)):
                same = sum(0 <= at + q < len(w) and w[at + q] == x for q, x in enumerate(n)) / len(n)
                if same >= 0.6 and any(at + p >= 0 and w[at + p : at + p + len(k)] == k for k, p in places):
                    out.add((label, max(at, 0), min(at + len(n), len(w)), same))
        return sorted(out, key=lambda s: (s[1], s[0], *s[2:]))

    filler = "obtaining redistribution hereby granted binary forms modification public domain "
    texts = [f"{a} x {b}" for a in notices[::3] for b in notices[::4]] + [filler * 3 + " y ".join(notices), " ".join(notices[4].split()[3:])]
    vocabulary = sorted({w for n in notices for w in n.split()})
    for _ in range(30):  # pieces of notices with words changed, dropped and put in between
        parts = []
        for n in rng.sample(notices, 4):
            w = n.split()
            lo = rng.randrange(max(1, len(w) // 4))
            w = [rng.choice(vocabulary) if rng.random() < 0.1 else x for x in w[lo : lo + rng.randint(len(w) // 2, len(w))]]
            parts += w + rng.choices(vocabulary, k=rng.randint(0, 6))
        texts.append(" ".join(parts))
    hits = 0
    for k, t in enumerate(texts):
        index = license_scan.LicenceIndex({w.encode(): rng.random() for n in notices for w in n.split()}) if k % 10 == 0 else index
        n_words, places, labels, score, spans = index.scan(t.encode())
        want = brute(t)
        base = [(i, b) for i in range(len(t.split())) for b, (p, _) in enumerate(license_scan.BASE) if t.split()[i : i + len(p.split())] == p.split()]
        assert spans == want and sorted(places) == base and n_words == len(t.split())
        assert labels == {s[0] for s in want} | {license_scan.BASE[b][1] for _, b in base}
        assert score == max([s[3] for s in want] + [0.5] * bool(base), default=0)
        hits += len(want)
    assert hits > 300
    everything = index.scan(" y ".join(notices).encode())[2]
    assert everything >= {label for label, *_ in license_scan.NOTICES}


# op2
KEY = "a key of the tests, long enough"


def test_surrogates(spark):
    t = ["call +1 (017) 555-7713, a.b@mail8.example.com a.b@mail8.example.com", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" at 55.63.178.142', "again a.b@mail8.example.com 4111 1111 1111 1111", "Anna Smith met Иван Петров", None, "", "no entity"]
    out = {r["doc_id"]: r for r in surrogates.surrogates(docs(spark, t), KEY).collect()}
    e = {r["entity"]: r["surrogate"] for r in surrogates.entity_table(docs(spark, t), KEY).collect()}
    assert len(e) == len(set(e.values())) == 7 and all(a != b for a, b in e.items())
    for i, x in enumerate(t):
        want = x
        for a, b in e.items():
            want = want.replace(a, b) if want else want
        assert out[i]["text"] == want
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", e["+1 (017) 555-7713"])
    assert re.fullmatch(r"[0-9a-f]{40}", e["b44e15e09fd311c3cf3163b66d5a9875b883d8ce"])
    card = [int(c) for c in e["4111 1111 1111 1111"] if c.isdigit()]
    assert (sum(card[1::2]) + sum(x * 2 - 9 * (x > 4) for x in card[::2])) % 10 == 0
    assert max(map(int, e["55.63.178.142"].split("."))) < 256
    assert e["Иван Петров"].split()[0] in surrogates.NAMES["given_m_cyrl"] and e["Anna Smith"].split()[0] in surrogates.NAMES["given_f"]
    assert out[4]["n_entities"] == 0 and out[6]["entity_types"] == ""


def test_phones_and_addresses_of_other_forms(spark):
    phones = ["+15551234567", "+33 6 12 34 56 78", "030 1234567", "+49 30 12345678", "06 12 34 56 78", "(030) 1234567", "+44 (20) 7946 0958"]
    ip6 = ["2001:db8::8a2e:370:7334", "2001:0DB8:0000:0000:0000:8A2E:0370:7334", "fe80::1"]
    plain = ["on 01.02.2024 and 03/04/2025", "at 12:30:45", "std::vector a::b", "0.12345678", "10 20 30 40", "+5 10", "page 012"]
    out = [r["text"] for r in surrogates.surrogates(docs(spark, [f"x {m}, y" for m in phones + ip6] + plain), KEY).orderBy("doc_id").collect()]
    for m, r in zip(phones + ip6, out, strict=False):
        s = r[2:-3]
        assert len(s) == len(m) and s != m and re.sub(r"[0-9a-f]", "0", s) == re.sub(r"[0-9a-f]", "0", m) or m in ip6 and "DB8" in m and re.sub(r"\w", "0", s) == re.sub(r"\w", "0", m)
        assert not any(len(g) > 3 and g in s for g in re.split(r"\D", m)) or m in ip6
    assert out[0].startswith("x +1") and out[1].startswith("x +33 ") and out[3].startswith("x +49 ") and out[len(phones + ip6) :] == plain
    assert {r["type"] for r in surrogates.entity_table(docs(spark, phones), KEY).collect()} == {"phone"} and surrogates.collisions(docs(spark, phones + ip6), KEY).count() == 0


def test_letters_of_all_scripts_move(spark):
    import unicodedata

    sample = [chr(x) for x in range(0x80, 0x30000, 7) if unicodedata.ucd_3_2_0.category(chr(x))[0] == "L"]  # letters that any JVM knows
    names = ["王小明", "王小红", "محمد", "דוד", "สมชาย", "άννα", "øßþ", "Łódź", "김철수", "𠀀𠀁", "иван", "ёж", "a王b", "ªº"]
    names += ["".join(sample[i : i + 60]) for i in range(0, len(sample), 60)]
    names += [chr(x) for x in range(0x430, 0x450)] + [chr(x) for x in range(0x4E00, 0x4E40)]
    t = [f"to {n}@例子.公司 now" for n in names] + ["to 中文@例子.公司 now"]
    d = docs(spark, t)
    e = {r["entity"]: r["surrogate"] for r in surrogates.entity_table(d, KEY).collect()}
    assert surrogates.collisions(d, KEY).count() == 0 and len(set(e.values())) == len(e)
    first = lambda m: next(i for i, c in enumerate(m) if c.isalpha())
    for m, s in e.items():
        assert len(m) == len(s) and m != s and m[first(m)] != s[first(m)]
        assert all(unicodedata.category(a)[0] == unicodedata.category(b)[0] for a, b in zip(m, s, strict=True))
    assert {len(e.get(f"{n}@例子.公司", "")) for n in names[:14]} == {len(n) + 6 for n in names[:14]}
    for r in surrogates.surrogates(d, KEY).collect():
        assert "例子.公司" not in r["text"] and r["n_entities"] == 1


def replaced(spark, texts, key=KEY, **more):
    return [r["text"] for r in surrogates.surrogates(docs(spark, texts), key, **more).orderBy("doc_id").collect()]


def test_only_numbers_with_a_check_digit_are_cards(spark):
    right, wrong = ["4111 1111 1111 1111", "5500000000000004", "3782 822463 10005"], ["4111 1111 1111 1112", "1234567890123456"]
    out = replaced(spark, [f"no {x} so" for x in right + wrong])
    for x, y in zip(right, out, strict=False):
        d = [int(c) for c in y if c.isdigit()][::-1]
        assert (sum(d[::2]) + sum(sum(divmod(2 * k, 10)) for k in d[1::2])) % 10 == 0 and y != f"no {x} so" and re.sub(r"\d", "0", y) == re.sub(r"\d", "0", f"no {x} so")
    assert out[len(right) :] == [f"no {x} so" for x in wrong]
    assert {r["n_entities"] for r in surrogates.surrogates(docs(spark, [f"no {x} so" for x in wrong]), KEY).collect()} == {0}


def test_reserved_addresses_and_top_level_domains_stay(spark):
    import ipaddress

    rng = random.Random(4)
    ips = ["10.0.0.1", "127.0.0.1", "192.168.1.7", "172.16.0.9", "172.31.255.255", "169.254.3.4", "172.15.1.1", "192.167.0.1", "8.8.8.8", "223.1.2.3", "100.64.0.1"]
    ips += [".".join(str(rng.choice([10, 172, 192, 8, 200, rng.randrange(1, 224)]) if k == 0 else rng.randrange(256)) for k in range(4)) for _ in range(150)]
    out = [x[1:-1] for x in replaced(spark, [f"({x})" for x in ips])]
    kind = lambda x: next((n for n in ("10.0.0.0/8", "127.0.0.0/8", "192.168.0.0/16", "172.16.0.0/12", "169.254.0.0/16") if ipaddress.ip_address(x) in ipaddress.ip_network(n)), "")
    assert all(x != y and kind(x) == kind(y) for x, y in zip(ips, out, strict=True))
    assert len({*out}) == len({*ips}) and surrogates.collisions(docs(spark, ips), KEY).count() == 0
    mails = replaced(spark, ["a.b@mail.example.com", "x@uni.ac.uk", "m@firma.de"])
    assert [m.rsplit(".", 1)[1] for m in mails] == ["com", "uk", "de"] and not any("example" in m or "firma" in m for m in mails)


def test_names_by_context_and_alone(spark):
    t = ["Alice Walker left. Later Alice spoke, and Walker's dog; malice, Alicent stay.", "Alice in wonder", "Mary said Dr. Zhivago and Mrs Dalloway met Emma Poppins.", "Paul And I", "Peter Clark and Clark, then Peter."]
    lists = {"given_f": ["Alice", "Emma", "Clara", "Eva"], "given_m": ["Peter", "Paul", "Martin", "Adam"], "family": ["Walker", "Fischer", "Baker", "Clark"]}
    a, b, c, d, e = replaced(spark, t, names=lists)
    m = re.fullmatch(r"(\w+) (\w+) left. Later (\w+) spoke, and (\w+)'s dog; malice, Alicent stay.", a)
    assert m[1] == m[3] != "Alice" and m[1] in lists["given_f"] and m[2] == m[4] != "Walker" and m[2] in lists["family"]
    assert b == t[1] and d == t[3]
    m = re.fullmatch(r"Mary said Dr. (\w{7}) and Mrs (\w{8}) met (\w+) (\w{7}).", c)
    assert m[1] != "Zhivago" and m[2] != "Dalloway" and m[3] in lists["given_f"] and m[3] != "Emma" and m[4] != "Poppins" and m[4].istitle()
    m = re.fullmatch(r"(\w+) (\w+) and (\w+), then (\w+).", e)
    assert m[1] == m[4] and m[2] == m[3] and m[2] in lists["family"] and m[1] in lists["given_m"]
    assert surrogates.collisions(docs(spark, t), KEY, lists).count() == 0
    with pytest.raises(ValueError):
        surrogates.Patterns({**lists, "family": ["a|b"]})
    with pytest.raises(ValueError):
        surrogates.Patterns({**lists, "family": ["Alice", "Clark"]})


def test_the_key_decides_and_stands_in_no_plan(spark, capsys):
    t = ["write to a.b@mail.example.com from 8.8.4.4"]
    assert replaced(spark, t) == replaced(spark, t) != replaced(spark, t, "another key that is long enough")
    for bad in ("", "short"):
        with pytest.raises(ValueError):
            surrogates.surrogates(docs(spark, t), bad)
    surrogates.surrogates(docs(spark, t), KEY).explain(True)
    plan = capsys.readouterr().out
    assert "sha2" in plan.lower() and not any(k in plan for k in [KEY, *surrogates.subkeys(KEY).values()]) and "Exchange hash" not in plan and "Python" not in plan


def test_surrogates_keep_columns_of_any_name(spark):
    d = docs(spark, ["mail a@b.example.com", "none"]).withColumn("_found", F.lit(1)).withColumn("_KEYS", F.lit(2)).withColumn("n_entities", F.lit("old")).withColumn("_one", F.lit(3))
    out = surrogates.surrogates(d, KEY)
    assert out.columns == [c for c in d.columns if c != "n_entities"] + ["n_entities", "entity_types"]
    assert [(r["_found"], r["_KEYS"], r["_one"], r["n_entities"]) for r in out.orderBy("doc_id").collect()] == [(1, 2, 3, 1), (1, 2, 3, 0)]


def test_surrogates_of_real_texts(spark):
    d = real(spark)
    assert surrogates.collisions(d, KEY).count() == 0
    after = surrogates.surrogates(d, KEY)
    left = d.select("doc_id", F.explode(surrogates.entities()).alias("e")).join(after.select("doc_id", F.col("text").alias("t")), "doc_id").where(F.expr("contains(t, e)"))
    assert left.count() == 0


# op3
@pytest.mark.parametrize("source", ["real", "edges"])
def test_fingerprints(spark, source):
    d = real(spark) if source == "real" else docs(spark, EDGES)
    rows = sorted(collected(d))
    got = {r["doc_id"]: r for r in sketch.fingerprints(d).collect()}
    assert len(got) == len(rows)
    prints = defaultdict(set)
    errors = []
    for k, (i, t) in enumerate(rows):
        t, other = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + other[:n] if n else t
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints[t].add(r["fingerprint"])
        prints[edited].add(r["edited_fingerprint"])
        a, b = (set(s.tolist()) for s in _text.shingles([t.encode(), edited.encode()], 5))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        (c,) = (set(s.tolist()) for s in _text.shingles([other.encode()], 5))
        for x, near, held in ((b, "near_edited", "in_edited"), (c, "near_next", "in_next")):
            exact = len(a | x) <= sketch.FLOOR  # nothing is left out of small sets
            if a and x:
                errors.append((abs(len(a & x) / len(a | x) - r[near]), exact))
                errors.append((abs(len(a & x) / len(a) - r[held]), exact))
        kept = [sketch.Sketch.decoded(r[f]) for f in ("fingerprint", "edited_fingerprint")]
        assert t == edited or sketch.likeness(*kept) == r["near_edited"]  # the stored print gives the number
        assert kept[0].encoded() == r["fingerprint"] and kept[0].n == len(a)
    assert all(len(p) == 1 for p in prints.values())
    assert max((e for e, exact in errors if exact), default=0) < 1e-9 and np.mean([e for e, _ in errors]) < 0.03 and max(e for e, _ in errors) < 0.25


def test_containment_of_unequal_texts():
    a, b, c = sketch.sketches([b" ".join(b"w%d" % i for i in r) for r in (range(400), range(20000), range(10000, 30000))])
    assert sketch.containment(a, b) == 1 and 0.005 < sketch.containment(b, a) < 0.06
    assert abs(sketch.containment(b, c) - 0.5) < 0.1 and len(b.hashes) < 20000 / 40
    both = sketch.merged(b, c)
    assert abs(both.n - 30000) < 3000 and sketch.containment(b, both) == sketch.containment(c, both) == 1
    assert sketch.merged(a, a).hashes.tolist() == a.hashes.tolist() and sketch.merged(a, a).limit == a.limit
    empty = sketch.sketches([b""])[0]
    assert sketch.containment(empty, a) == 0 and sketch.likeness(empty, a) == 0 and sketch.merged(empty, a).hashes.tolist() == a.hashes.tolist()


# op4
def test_packing(spark):
    from tokenizers import Tokenizer

    d = real(spark).select("doc_id", "text").unionByName(docs(spark, [(10**6 + i, t) for i, t in enumerate([*EDGES, "日本語 <|endoftext|> naïve \u0085 ❤️", "tab\there\x0b\x1c"])]).select("doc_id", "text")).where("doc_id <> 1000006")
    tok = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in collected(d)}
    got, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(d, with_ids=True).collect():
        assert r["length"] == len(r["ids"]) and r["doc_tokens"] == len(want[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        got[r["doc_id"]].append((r["start"], r["ids"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in got.items()} == want
    for p in sequences.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 2048
    assert sum(sum(n for _, n in p) < 2048 for p in sequences.values()) <= 1 and sorted(sequences) == list(range(len(sequences)))


# op5
def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(d, labels)
    got = quality.quality(d, model).join(labels.select("doc_id", "quality"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert np.mean([r["predicted"] for r in held if r["quality"] == 1]) > 0.97


def test_quality_edges(spark):
    m = quality.train(docs(spark, PROSE), spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    got = quality.quality(docs(spark, EDGES), m).collect()
    assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)


# op6
def brute_dedup(rows, min_words):
    """Lines covered by any run of at least min_words words that stands earlier too."""
    rows = sorted(rows)
    seen, cut = {}, defaultdict(set)
    for i, t in rows:
        lines = [x.strip(" \t\r\n\x0b\x0c") for x in (t or "").split("\n")]
        words = [len(x.split()) for x in lines]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(words[a : b + 1]) >= min_words and words[a] and words[b]:
                    k = tuple(lines[a : b + 1])
                    if k in seen and seen[k] != (i, a):
                        cut[i] |= set(range(a, b + 1))
                    seen.setdefault(k, (i, a))
    return {i: t if i not in cut else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut[i]) for i, t in rows}


def test_line_dedup_brute(spark):
    rng = random.Random(7)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 4))) for _ in range(12)]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 12))) for _ in range(40)] + ["", None, pool[0], "  " + pool[1] + " \n\n"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs(spark, texts), 6).collect()}
    assert got == brute_dedup(list(enumerate(texts)), 6)


def test_ranks_are_those_of_the_sorted_suffixes(spark):
    """In each round, ranks order the suffixes by their first k lines, equal where these are, and are there where these repeat."""
    rng = random.Random(11)
    pool = [rng.choice("abc") + (" x" * rng.randint(0, 2)) for _ in range(4)] + [""]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(5, 30))) for _ in range(25)]
    lines = [x.split("\n") for x in texts]
    ids = {x: i for i, x in enumerate(sorted({y.strip(" ") for x in lines for y in x}, key=lambda y: tuple(int(h[0]) for h in line_dedup.line_ids([y.encode()])[3:])))}
    base = docs(spark, texts).select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    total = 0
    for k, state, _ in line_dedup.rounds(base, 9):
        prefix = lambda d, i: tuple(ids[y.strip(" ")] for y in lines[d][i : i + k])  # noqa: B023, E731
        every = defaultdict(int)
        for d, x in enumerate(lines):
            for i in range(len(x) - k + 1):
                every[prefix(d, i)] += 1
        rows = [(prefix(r["doc_id"], r["line"]), r["rank"]) for r in state.collect()]
        there = sorted((p, r) for p, r in rows if r is not None)
        assert all(len(p) == k and every[p] > 1 for p, _ in there)
        assert all((p == q) == (r == t) and (p < q) == (r < t) for (p, r), (q, t) in zip(there, there[1:], strict=False))
        total += len(there)
    assert total > 200 and k >= 4


def test_line_dedup_of_many_separate_runs_and_hot_lines(spark):
    import time

    runs = [" ".join(random.Random(i).choices("abcdefgh", k=8)) for i in range(3000)]
    texts = ["\n".join(runs), "\n".join(f"{x}\nown {i}" for i, x in enumerate(runs))] + ["common line of six words here\n" * 40 + f"tail {i}" for i in range(60)]
    t = time.time()
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs(spark, texts), 6).collect()}
    assert time.time() - t < 60
    assert got[0] == texts[0] and got[1] == "\n".join(f"own {i}" for i in range(3000))
    assert got[2] == "common line of six words here\ntail 0" and all(got[i] == f"tail {i - 2}" for i in range(3, 62))


def test_line_dedup_replaces_or_leaves_out_its_count(spark):
    d = docs(spark, PROSE[:3]).withColumn("n_deleted", F.lit("mine")).withColumn("_starts", F.lit(1)).withColumn("_New", F.lit(2))
    out = line_dedup.line_dedup(d)
    assert out.columns == [c for c in d.columns if c != "n_deleted"] + ["n_deleted"] and {r["n_deleted"] for r in out.collect()} == {0}
    out = line_dedup.line_dedup(d, counted=None)
    assert out.columns == d.columns and {r["n_deleted"] for r in out.collect()} == {"mine"}
    assert line_dedup.line_dedup(docs(spark, [(None, PROSE[0] * 2), (None, PROSE[0] * 2), (1, PROSE[0] * 2)])).where("text = ''").count() == 1


def test_line_dedup_rules(spark):
    run = "\n".join(PROSE[:2])
    d = docs(spark, [run, "own line\n" + run + "\nend", run, None, "", "short\nshort"])
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(d, drop_emptied=True).collect()}
    assert out[0]["text"] == run and out[1]["text"] == "own line\nend" and out[1]["n_chars"] == 12 and out[1]["n_deleted"] == 2
    assert 2 not in out and out[3]["text"] is None and out[4]["text"] == "" and out[5]["text"] == "short\nshort"
    assert out[0]["component_id"] == 1


# op7
def test_decontamination(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [t for _, t in collected(real(spark)) if t and not any(" ".join(x.split()) in " ".join(t.split()) for _, x in items)]
    planted = [(10**6 + i, f"{clean[i % len(clean)][:300]}\n{t}\n{PROSE[i % 8]}") for i, (_, t) in enumerate(items)]
    noisy = [(2 * 10**6 + i, " ".join(w.upper() + "##" for w in f"{PROSE[0]} {t} {PROSE[1]}".split())) for i, (_, t) in enumerate(items)]
    d = docs(spark, [*enumerate(clean), *planted, *noisy, (5 * 10**6, None), (5 * 10**6 + 1, "")])
    b = spark.createDataFrame([*items, (None, "x"), (10**6, None), (10**6 + 1, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.decontaminate(d, b).collect()}
    assert got == {(i, k) for (i, _), (k, _) in zip(planted, items, strict=True)} | {(i, k) for (i, _), (k, _) in zip(noisy, items, strict=True)}
    whole, blocks = (sorted(map(tuple, decontaminate.decontaminate(d, b, block_bytes=n).collect())) for n in (10**9, 2000))
    assert len(whole) == len(blocks) and all(x[:2] == y[:2] and np.allclose(x[2:], y[2:]) for x, y in zip(whole, blocks, strict=True))
    assert decontaminate.without_leaks(d, b).count() == d.count() - len(planted) - len(noisy)


def test_long_items_do_not_widen_the_windows_of_short_ones(spark):
    short = [(i, " ".join(f"s{i}q{k}" for k in range(12)) + ". " + " ".join(f"s{i}a{k}" for k in range(4)) + ".") for i in range(4)]
    long = [(10 + i, " ".join(f"t{i}x{k}" for k in range(n)) + ". The end.") for i, n in enumerate((90, 700, 3000))]
    rng = random.Random(2)
    filler = lambda n: " ".join(f"f{rng.randrange(500)}" for _ in range(n))
    spread = [(i, " ".join(f"{filler(100)} {w}" for w in t.replace(".", "").split())) for i, t in short]  # a word of the item in every 101 words
    holding = [(100 + i, f"{filler(150)} {t} {filler(333)}") for i, t in short + long]
    d, b = docs(spark, spread + holding), spark.createDataFrame(short + long, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.decontaminate(d, b).collect()}
    assert got == {(100 + i, i) for i, _ in short + long}
    assert {r["doc_id"] for r in decontaminate.without_leaks(d, b).collect()} == {i for i, _ in spread}


def bm25(items, threshold, text, window):
    """Scores of all items in all windows by the formula, over item texts: {item: best share of its own score}."""
    bags = {i: decontaminate.words_of(t) for i, t in items}
    df, mean = defaultdict(int), sum(map(len, bags.values())) / len(bags)
    for bag in bags.values():
        for w in set(bag):
            df[w] += 1

    def impact(bag, w):
        tf = bag.count(w)
        return np.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / mean))

    words, out = decontaminate.words_of(text), {}
    for at in range(0, max(1, len(words)), window // 2):
        present = set(words[at : at + window])
        for i, bag in bags.items():
            own = {w: impact(bag, w) for w in set(bag)}
            x = sum(v for w, v in own.items() if w in present) / sum(own.values())
            if x >= threshold - 1e-9:
                out[i] = max(out.get(i, 0), x)
    return out


@pytest.mark.parametrize("block_bytes", [400, 10**9])
def test_scores_are_those_of_the_formula_in_any_blocks(spark, block_bytes):
    """Items of early blocks share words that are rare in late ones."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    draw = lambda n, lo=0: " ".join(vocabulary[int(lo + (300 - lo) * x**3)] for x in rng.random(n))
    items = [(i, draw(20, 150 if i < 20 else 0)) for i in range(60)]
    texts = [draw(30) + " " + " ".join(items[i][1].split()[: rng.integers(5, 20)]) + " " + draw(200) for i in range(60)]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.decontaminate(docs(spark, texts), b, 0.5, 64, 0.0, 0.0, block_bytes).collect()}
    want = {(t, i): x for t, text in enumerate(texts) for i, x in bm25(items, 0.5, text, 64).items()}
    assert set(got) == set(want) and len(want) > 40 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("block", [1, 4, 16])
def test_wand_finds_what_scoring_all_finds(block):
    rng = np.random.default_rng(block)
    vocabulary = [f"w{i}" for i in range(200)]
    draw = lambda n: " ".join(vocabulary[int(200 * x**3)] for x in rng.random(n))
    items = [(i, draw(15)) for i in range(150)]
    for threshold in (0.3, 0.6):
        index = decontaminate.Index(items, threshold, block=block)
        for _ in range(40):
            present = index.lookup(index._hashes(sorted(set((draw(25) + " " + items[rng.integers(150)][1]).split()))))
            present = np.unique(present[present >= 0])
            want = {i for i in range(150) if index.score(present, i) >= threshold - 1e-9}
            got = index.wand(present[index.essential[present]])
            assert want <= set(got) and len(set(got)) == len(got) and got == sorted(got)


# op8
def brute_join(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            same = len(x & y)
            if same and 100 * same >= percent * (len(x) + len(y) - same):
                p, q = root(ids[a]), root(ids[b])
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


def edited(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("size", "percent", "chunk"), [(4, 85, 10**6), (5, 80, 10**6), (4, 85, 700), (2, 60, 10**6)])
def test_ngram_join(spark, size, percent, chunk):
    rng = random.Random(size)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n in (3, 5, 9, 17, 40, 90, 200, 450)]
    texts = [edited(t, rng.randrange(1 + len(t.split()) // 12), rng) for t in base for _ in range(14)] + EDGES + PROSE + [base[5] + f" tail{i}" for i in range(30)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs(spark, rows), size, percent, chunk).collect()}
    assert got == brute_join(rows, size, percent)


@pytest.mark.parametrize("chunk", [2500, 9000])
def test_ngram_join_of_large_groups(spark, chunk):
    """A hub with many near copies, a chain that drifts away from it, and a second family, in clusters of many chunks."""
    rng = random.Random(chunk)
    hub, other = (" ".join(f"{c}{rng.randrange(5000)}" for _ in range(150)) for c in "uv")
    chain = [hub]
    for _ in range(40):
        chain.append(edited(chain[-1], 2, rng))
    mixed = " ".join(hub.split()[:75] + other.split()[:75])
    texts = [edited(hub, rng.randrange(4), rng) for _ in range(70)] + chain + [edited(other, rng.randrange(5), rng) for _ in range(50)] + [edited(mixed, 1, rng) for _ in range(20)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs(spark, rows), 4, 85, chunk).collect()}
    assert got == brute_join(rows, 4, 85)


def test_cores_are_not_compared_with_each_other(spark):
    """The work of a group of near copies follows its size, not the square of it."""
    import numpy as np

    rng = np.random.default_rng(3)
    hub = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    sets = [np.unique(np.r_[hub[int(rng.integers(0, 10)) :], rng.integers(0, 1 << 63, 5).astype(np.uint64)]) for _ in range(300)]
    rows = [(ngram_join.set_key(s), i, len(s), 1, bytearray(s.tobytes())) for i, s in enumerate(sets)]
    d = spark.createDataFrame(rows, "set_key long, rep long, n long, cluster long, features binary")
    near = spark.createDataFrame([(rows[0][0], r[0]) for r in rows[1:]], "a long, b long")
    from pyspark.sql import functions as F

    alone = F.array(F.struct(F.lit(0).cast("long").alias("t"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    tasks, links = ngram_join.around_pivots(d.select("set_key", "rep", "n", "cluster"), d.select("set_key", "features"), near, 85, 2000, alone)
    assert links.count() >= 290
    assert (tasks.selectExpr("size(tasks) AS k").agg({"k": "sum"}).first()[0] or 0) <= 300


@pytest.mark.parametrize("percent", [85, 60])
def test_sketches_divide_as_brute_force_does(monkeypatch, percent):
    rng = np.random.default_rng(percent)
    draw = lambda n: rng.integers(0, 1 << 63, int(n)).astype(np.uint64)
    bases = [draw(rng.integers(3, 400)) for _ in range(6)]
    sets = [np.unique(np.r_[b[rng.random(len(b)) > rng.choice([0.02, 0.1, 0.2, 0.4])], draw(rng.integers(1, 2 + len(b) // 8))]) for b in bases for _ in range(30)]
    n, sketches = np.array([len(s) for s in sets]), [ngram_join.parity_sketch(s, percent) for s in sets]

    def near(i, j):
        w = min(len(sketches[i]), len(sketches[j])) // 8
        x, y = (np.bitwise_xor.reduce(np.frombuffer(sketches[k], np.uint64).reshape(-1, w), 0) for k in (i, j))
        return percent * max(n[i], n[j]) <= 100 * min(n[i], n[j]) and int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= (100 - percent) * (n[i] + n[j])

    def classes(edges):
        of = list(range(len(n)))
        for i, j in edges:
            of = [of[i] if x == of[j] else x for x in of]
        return [of.index(x) for x in of]

    for sides in (np.zeros(len(n), int), rng.integers(0, 2, len(n))):
        want = classes([(i, j) for i in range(len(n)) for j in range(i) if (sides.max() == 0 or sides[i] != sides[j]) and near(i, j)])
        for probed in (4, 256):
            monkeypatch.setattr(ngram_join, "PROBED", probed)
            label = ngram_join.alike_classes(n, sketches, sides, percent).tolist()
            assert [label.index(x) for x in label] == want


def test_sets_with_a_common_phrase_are_not_dealt_chunk_against_chunk(spark, monkeypatch):
    """They share large buckets and so one cluster of many chunks, but no links: only their sketches meet."""
    rng = random.Random(8)
    phrase = " ".join(f"common{i}" for i in range(10))
    texts = [phrase + "".join(f" w{rng.randrange(10**6)}" for _ in range(6)) for _ in range(400)]
    texts += [t + " tail" for t in texts[:20]]
    rows = list(enumerate(texts))
    divided, pivots, seen = ngram_join.divided, [], []
    monkeypatch.setattr(ngram_join, "divided", lambda members, *a: seen.append(members.count()) or divided(members, *a))
    monkeypatch.setattr(ngram_join, "around_pivots", lambda *a: pivots.append(a))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs(spark, rows), 4, 85, 700).collect()}
    assert got == brute_join(rows, 4, 85)
    assert seen[0] > 100 and not pivots


def test_a_chunk_of_near_copies_takes_little_time():
    import time

    rng = np.random.default_rng(9)
    hub = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = [np.unique(np.r_[hub[rng.permutation(60)[:58]], rng.integers(0, 1 << 63, 1).astype(np.uint64)]) for _ in range(4000)]
    t = time.time()
    a, b = ngram_join.linked_forest(np.arange(4000), sets, np.zeros(4000, int), 85)
    assert len(a) == 3999 and time.time() - t < 5
    loose = [np.unique(np.r_[s[:30], rng.integers(0, 1 << 63, 30).astype(np.uint64)]) for s in sets[:300]]
    forest = ngram_join.linked_forest(np.arange(600), sets[:300] + loose, np.zeros(600, int), 85)
    assert len(forest[0]) == 299


def test_one_of_each(spark):
    copy = PROSE[0] + " tail"
    rows = [(7, copy), (7, copy), (9, copy), (9, PROSE[1]), (5, PROSE[2]), (6, PROSE[2].upper()), (8, None), (8, None), (8, ""), (None, copy), (None, PROSE[3]), (None, PROSE[3]), (3, PROSE[4] + " a b"), (2, PROSE[4])]
    d = docs(spark, rows).withColumn("_gone", F.lit(1)).withColumn("_row", F.lit("r"))
    out = ngram_join.one_of_each(d)
    assert out.columns == d.columns
    got = sorted(map(repr, collected(out)))
    assert got == sorted(map(repr, [(7, copy), (9, PROSE[1]), (5, PROSE[2]), (8, None), (8, ""), (None, PROSE[3]), (2, PROSE[4])]))
    assert ngram_join.one_of_each(d.where("false")).count() == 0


@pytest.mark.parametrize("percent", [60, 75, 80, 85, 95])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for n in [*range(1, 60), 100, 333, 1000]:
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        drop = rng.integers(0, len(a) + 1)
        b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 1 << 63, rng.integers(0, n + 1)).astype(np.uint64)])
        same = len(np.intersect1d(a, b))
        if same and 100 * same >= percent * (len(a) + len(b) - same):
            assert np.intersect1d(ngram_join.signatures(a, percent), ngram_join.signatures(b, percent)).size
        k = (100 - percent) * 2 * n // (100 + percent) // 2
        c = np.unique(np.r_[a[k:], rng.integers(0, 1 << 63, k).astype(np.uint64)])
        same = len(np.intersect1d(a, c))
        if 100 * same >= percent * (len(a) + len(c) - same):
            assert np.intersect1d(ngram_join.signatures(a, percent), ngram_join.signatures(c, percent)).size


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3), (900, 900)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


# op9
PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site <b>name</b></header><nav><ul><li>Home<li>About</ul></nav>
<div class="cookie-notice">We use cookies.</div><main><article><h1>Title &amp; more</h1><p>First   paragraph
with a break<br>inside &eacute;.<p>Short.</p><div class="advert"><p>Buy now</p></div><p>Last one is a longer paragraph of text.</p>
<form><input value=x><button>Send</button></form><section class="comments"><p>First reader comment</p></section></article></main><aside class="sidebar">Links</aside>
<script>var a = "<p>no</p>";</script><footer>Footer</footer></body></html>"""


def test_html(spark):
    assert html_extract.main_text(PAGE) == "Title & more\nFirst paragraph with a break inside é.\nShort.\nLast one is a longer paragraph of text."
    plain = "<body><div class=menu><a>A</a> <a>B</a></div><div><p>" + "A long paragraph of real text. " * 5 + "<p>" + "And another long one here. " * 5 + "</div><div><a>x</a><a>y</a><a>z</a></div>"
    assert html_extract.main_text(plain).startswith("A long paragraph") and "x" not in html_extract.main_text(plain).split("\n")[-1][:2]
    d = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>unclosed"), (4, "u", PAGE), (4, "u", PAGE), (5, "u", "<" * 2000)], "page_id long, url string, html string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(d).orderBy("page_id").collect()]
    assert got[:3] == [(1, "", 0), (2, "", 0), (3, "unclosed", 8)] and got[3] == got[4] and len(got) == 6


def test_html_keeps_all_sections_of_an_article():
    sections = ["a" * n for n in (10, 11, 12, 13)] + ["b" * 300, "c" * 300, "d" * 9, "e" * 8, "f" * 7]
    body = "".join(f"<section><p>{x}</p></section>" for x in sections)
    for tag in ("article", "main"):
        assert html_extract.main_text(f"<body><div>menu text</div><{tag}>{body}<div class=related><p>no</p></div></{tag}></body>").split("\n") == sections
    assert html_extract.main_text(f"<div>{'g' * 400}</div><div><a>x</a><a>y</a></div>") == "g" * 400


def test_html_marks_are_whole_names():
    long = "A sentence of the text that goes on for a while, as they do. " * 4
    page = f"""<body><div class="site-header top">Site</div><article><div class="post-header"><h1>The title</h1></div><p>{long}</p>
<div id="search-engine-history"><p>{long}</p></div><div class="ad-slot-3">Buy</div><div class="comments_list"><p>{long}</p></div><div><p>The end.</p></div></article><div class="search">x</div></body>"""
    assert html_extract.main_text(page).split("\n") == ["The title", long.strip(), long.strip(), "The end."]


def test_html_without_article_markup():
    rng = random.Random(4)
    for _ in range(40):
        paragraphs = [" ".join(rng.choices(PROSE[0].split(), k=rng.randint(30, 90))) for _ in range(rng.randint(3, 8))]
        short = "So it ends."
        menu = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(rng.randint(4, 12)))
        text = "".join(rng.choice([f"<p>{x}</p>", f"<div>{x}</div>", f"<p><b>{x[:9]}</b>{x[9:]}<br>"]) for x in paragraphs)
        body = f"<div class=top><ul>{menu}</ul></div><div id=c><h2>A title</h2>{text}<div><p>{short}</p></div></div><div><ul>{menu}</ul></div>"
        assert html_extract.main_text(f"<body>{body}</body>").split("\n") == ["A title", *paragraphs, short]
        # each paragraph in a box of its own, and a short one between two of them
        apart = f"<ul>{menu}</ul>" + f"<div><p>{paragraphs[0]}</p></div><div><p>{short}</p></div>" + "".join(f"<div><p>{x}</p></div>" for x in paragraphs[1:]) + f"<ul>{menu}</ul>"
        assert html_extract.main_text(apart).split("\n") == [paragraphs[0], short, *paragraphs[1:]]


def test_html_clusters_choose_the_regions():
    long = "A sentence of the text that goes on for a while, as they do. " * 4
    page = f"<body><div><p>Links <a>a</a> <a>b</a> <a>c</a></p></div><article><p>One</p></article><article><p>{long}</p><p>{long}</p></article><div><i>o</i><b>p</b><u>q</u></div></body>"
    assert html_extract.main_text(page) == f"{long.strip()}\n{long.strip()}"
    assert html_extract.main_text(page, lambda lines, _: [True] * len(lines)) == f"One\n{long.strip()}\n{long.strip()}"
    assert html_extract.main_text(page, lambda lines, _: [x.text == "One" for x in lines]) == "One"
    assert html_extract.main_text(page.replace("article", "div")) == f"{long.strip()}\n{long.strip()}"


def test_html_time_follows_the_length():
    import time

    for tag in ("<div>", "<p><b>", "<li>", "<ul><li>", "<div class='a b c'>", "<a><i>", "</div>", "<p>x</b>", "<article>t"):
        t = time.time()
        html_extract.main_text(tag * (1_000_000 // len(tag)))
        assert time.time() - t < 20, tag


def test_html_of_the_pages(spark):
    import html

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        m = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"], re.S)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?p>|</?h1>|<br>", m[1])]
        assert html_extract.main_text(r["html"]) == "\n".join(b for b in blocks if b)


# op10
def test_chat(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\nIt is long."), (1, 1, "assistant", "Use sorted on the list.\nIt returns a new list."), (1, 2, "user", "Another topic altogether, please."),
        (1, 3, "assistant", "> How do I sort\n> a list? It is long.\nAnswer to the first."), (1, 4, "user", ">> How do I sort a list?\n> Use sorted on the list.\nThanks for that."),
        (1, 4, "user", ">> How do I sort a list?\n> Use sorted on the list.\nThanks for that."), (2, 5, "user", None), (2, 9, None, "> not found anywhere at all\nhello"), (3, None, "user", "no turn"), (None, 0, "user", "no conversation"),
    ]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in chat.linked(c).collect()}
    assert len(got) == 9
    assert got[1, 0]["reply_to"] is None and got[1, 1]["reply_to"] == 0 and got[1, 2]["reply_to"] == 1
    assert got[1, 3]["reply_to"] == 0 and got[1, 3]["text"] == "Answer to the first."
    assert got[1, 4]["reply_to"] == 1 and set(got[1, 4]["links"]) == {0, 1} and got[1, 4]["text"] == "Thanks for that."
    assert got[2, 9]["reply_to"] == 5 and got[2, 9]["links"] == [] and got[2, 9]["text"] == "> not found anywhere at all\nhello" and got[2, 5]["text"] == ""
    out = {(r["conv_id"], r["segment"]): r for r in chat.chat_format(c.withColumn("segment", F.lit(1)).withColumn("links", F.lit(2)), segment=3).collect()}
    # 3 answers 0 as 1 does; 2 and 4 answer 1
    assert [m["turn"] for m in out[1, 0]["messages"]] == [0, 1, 3] and [m["turn"] for m in out[1, 1]["messages"]] == [2, 4]
    assert out[1, 0]["n_linked"] == out[1, 1]["n_linked"] == 1
    assert not any(">" in m["text"] for k, r in out.items() for m in r["messages"] if k[0] == 1)


def brute_chat(rows, min_words):
    """{(conv, turn, role): (text, reply_to, links, position)} of conversations without nulls, with one message a turn and role."""
    norm = lambda t: " ".join(t.lower().split())
    out = {}
    for conv in {c for c, *_ in rows}:
        ms = sorted({(t, r, x) for c, t, r, x in rows if c == conv})

        def parse(x):
            runs = []
            for raw in x.split("\n"):
                marks = re.match(r"[ \t]*(?:>[ \t]?)+", raw)
                level, line = (marks[0].count(">"), raw[len(marks[0]) :]) if marks else (0, raw)
                if not runs or runs[-1][0] != level:
                    runs.append((level, []))
                runs[-1][1].append((raw, line))
            return runs

        own = defaultdict(set)
        for t, _, x in ms:
            free = [r for r in parse(x) if r[0] == 0]
            for k in {norm(" ".join(y for r in free for _, y in r[1])), *(norm(" ".join(y for _, y in r[1])) for r in free), *(norm(y) for r in free for _, y in r[1])} - {""}:
                own[k].add(t)
        find = lambda k, t: min((o for o in own.get(k, ()) if o < t), default=None) if own.get(k) and min(own[k]) < t else None  # noqa: E731, B023
        reply = {}
        for t, r, x in ms:
            kept, links, cut = [], set(), False
            for level, ys in parse(x):
                whole = find(norm(" ".join(y for _, y in ys)), t) if level else None
                each = [find(norm(y), t) if level and norm(y) else None for _, y in ys]
                good = [o for o, (_, y) in zip(each, ys, strict=True) if o is not None and len(y.split()) >= min_words]
                links |= {(level, 0, -whole)} if whole is not None else set()
                links |= {(level, 1, -o) for o in good}
                hit = whole is not None or bool(good)
                for o, (raw, y) in zip(each, ys, strict=True):
                    if hit and (whole is not None or o is not None or not norm(y)):
                        cut = True
                    else:
                        kept.append(raw)
            links = [-o for _, _, o in sorted(links)]
            links = list(dict.fromkeys(links))
            before = max((u for u, *_ in ms if u < t), default=None)
            reply[t, r] = links[0] if links else before
            out[conv, t, r] = ["\n".join(kept).strip("\n") if cut else x, reply[t, r], links]
        order = sorted({(-1 if reply[t, r] is None else reply[t, r], t) for t, r, _ in ms})
        for t, r, _ in ms:
            out[conv, t, r].append(order.index((-1 if reply[t, r] is None else reply[t, r], t)))
    return {k: tuple(v) for k, v in out.items()}


def test_chat_against_brute_force(spark):
    rng = random.Random(8)
    words = "alpha beta gamma delta epsilon zeta".split()
    rows = []
    for conv in range(25):
        said = []
        for t in range(rng.randint(3, 14)):
            for role in rng.sample(["user", "assistant"], rng.choice([1, 1, 2])):
                lines = []
                for _ in range(rng.randint(1, 4)):
                    if said and rng.random() < 0.5:
                        old = rng.choice(said).split("\n")
                        lo = rng.randrange(len(old))
                        marks = rng.choice(["> ", ">", ">> ", " > "])
                        lines += [marks + (x if rng.random() < 0.9 else x + " changed").upper() for x in old[lo : lo + rng.randint(1, 3)]]
                    else:
                        lines += [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 2))] + [""] * (rng.random() < 0.2)
                    if rng.random() < 0.1:
                        lines.append(">>> import os")
                said.append("\n".join(lines))
                rows.append((conv, 2 * t, role, said[-1]))
    c = spark.createDataFrame(rows + rows[:20], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"], r["role"]): (r["text"], r["reply_to"], r["links"], r["position"]) for r in chat.linked(c).collect()}
    want = brute_chat(rows, 3)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert got == want and sum(bool(v[2]) for v in want.values()) > 40


def test_prompts_stay(spark):
    rows = [(1, 0, "user", "Try this:\n>>> import os\n>>> os.getcwd()\nIt fails."), (1, 1, "assistant", "> It fails.\n> from a letter nobody sent here\nWhy?")]
    got = [r["text"] for r in chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 2).orderBy("turn").collect()]
    assert got == [rows[0][3], "> from a letter nobody sent here\nWhy?"]


def test_chat_long_conversation(spark):
    n = 10_000
    c = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), (F.col("id") * 3).alias("turn"), F.lit("user").alias("role"), F.lit("hi there").alias("text"))
    got = chat.linked(c).agg(F.count("*"), F.sum((F.col("reply_to") == F.col("turn") - 3).cast("long")), F.max("position"), F.countDistinct("position")).first()
    assert tuple(got) == (n, n - 1, n - 1, n)


def test_stored_tables_leave_no_shuffle_files(spark):
    import time

    from quillon.llm._text import DROPS, stored, unstored

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before, was = files(), spark.conf.get(DROPS)
    table = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert sorted(map(tuple, table.collect())) == [(k, len(range(k, 1000, 7))) for k in range(7)]
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(DROPS) == was
    unstored(table)


def test_tables_that_grow_with_the_documents_are_not_broadcast(spark):
    from quillon.llm import ngram_join
    from quillon.llm._text import storing

    name = "spark.sql.autoBroadcastJoinThreshold"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    a, b = spark.range(100_000), spark.range(100_000)  # 800 KB by estimate
    set_before = spark.conf.get(name)
    assert "BroadcastHashJoin" in plan(a.join(b, "id"))
    with storing(spark):
        assert "BroadcastHashJoin" not in plan(a.join(b, "id"))
        assert "BroadcastHashJoin" in plan(a.join(spark.range(1000), "id"))
    assert spark.conf.get(name) == set_before
    try:
        spark.conf.set(name, "-1")
        with storing(spark):
            assert "BroadcastHashJoin" not in plan(a.join(spark.range(1000), "id"))
        assert spark.conf.get(name) == "-1"
    finally:
        spark.conf.unset(name)
    texts = ["a b c d e f g h i j", "a b c d e f g h i j", "k l m n o p q", "", None]
    out = ngram_join.ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(map(tuple, out.collect())) == [(0, 7, 0), (1, 7, 0), (2, 4, 2), (3, 0, 3), (4, 0, 4)]
    assert "BroadcastHashJoin" not in plan(out) and "BroadcastExchange" not in plan(out)


def test_classes_of_sketches_are_stars():
    """Around the smallest key: a chain or a random tree of as many edges takes more rounds, and more rows in each."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    hub = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    sets = [np.unique(np.r_[hub[rng.permutation(100)[:97]], rng.integers(0, 1 << 63, 1).astype(np.uint64)]) for _ in range(600)]
    keys = rng.permutation(600)
    table = pa.table({"set_key": keys, "size": [len(s) for s in sets], "sketch": [ngram_join.parity_sketch(s, 80) for s in sets], "chunks": [1] * 600, "chunk": [0] * 600, "i": [0] * 600, "j": [0] * 600})
    edges = ngram_join._alike(80)(table)
    assert set(edges.column("a").to_pylist()) == {0} and all(edges.column("whole").to_pylist()) and sorted(edges.column("b").to_pylist()) == list(range(1, 600))
