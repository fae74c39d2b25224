import datetime
import hashlib
import random
import re
import string
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from textdelta.llm import decontaminate, jaccard_join, line_dedup, pieces, pseudonyms, substring_dedup, toxicity

from .helpers import documents, hard_texts, prose

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_substring_dedup_against_brute_force(spark):
    texts = hard_texts()
    first = {}
    words = [(i, SPACE_WORDS.findall(t or "")) for i, t in texts]
    for i, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    want = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    docs = documents(spark, texts)
    got = [tuple(r) for r in substring_dedup.digest(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert substring_dedup.digest(docs.limit(0)).count() == 0


def brute_components(texts, k, num, den):
    sets, up = {}, {}
    for i, t in texts:
        w = SPACE_WORDS.findall((t or "").translate(LOWER))
        own = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
        sets[i] = own
        up[i] = i
    find = lambda x: x if up[x] == x else find(up[x])
    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if inter * den >= (len(sets[a]) + len(sets[b]) - inter) * num:
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_jaccard_components_against_brute_force(spark, k, num, den):
    rng = random.Random(3)
    texts = [x for x in hard_texts(2) if x[0] != 500]
    base = prose(rng, 150).split()
    for i in range(40):  # a group at the border of similarity
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(1000)}"
        texts.append((600 + i, " ".join(words)))
    docs = documents(spark, texts)
    got = jaccard_join.jaccard_components(docs, k=k, num=num, den=den).collect()
    want = brute_components(texts, k, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert len(got) == len(texts) and [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_blocks_and_parts(spark, monkeypatch):
    """Crowded tokens over several blocks, and probes in several parts, lose no link."""
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(jaccard_join, "PART_TOKENS", 400)
    texts = [x for x in hard_texts(4) if x[0] not in (500, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, texts)).collect()}
    assert got == brute_components(texts, 4, 85, 100)
    links = {(r.a, r.b) for r in jaccard_join.JaccardJoin(documents(spark, texts)).links().collect()}
    assert links and all(a < b for a, b in links)


def test_near_copies_make_rows_in_proportion(spark, monkeypatch):
    """A large group of near copies over many blocks, with one passage in all other documents too."""
    rng = random.Random(15)
    base, everywhere = prose(rng, 120).split(), prose(rng, 8)
    texts = []
    for i in range(1500):
        words = list(base)
        words[rng.randrange(120)] = f"n{i}"
        texts.append((i, " ".join(words)))
    texts += [(2000 + i, f"{everywhere} {prose(rng, 30)}") for i in range(300)]
    sizes = []

    def counted(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    cut = jaccard_join.cut
    monkeypatch.setattr(jaccard_join, "cut", counted)
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 6000)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(documents(spark, texts)).collect()}
    assert all(got[i] == 0 for i in range(1500)) and all(got[2000 + i] == 2000 + i for i in range(300))
    assert max(sizes) <= 2 * len(texts)


def test_groups_send_each_hash_once():
    """A passage that all documents hold is one hash a group and bucket, however many hold it."""
    import pyarrow as pa

    rng = random.Random(16)
    shared = prose(rng, 40)
    docs = pa.table({"id": list(range(500)), "text": [f"{prose(rng, 5, 5000)} {shared}" for _ in range(500)], "part": [3] * 500})
    hashes = substring_dedup.unpack(substring_dedup._probe(13, 64)(docs))[0]
    assert len(hashes) < 34 + 500 * 7
    hashes = jaccard_join.unpack(jaccard_join._post(4, 64)(docs), extra_dtype=np.uint16)
    assert len(hashes[0]) < 37 + 500 * 6 and (hashes[-1] == 500).sum() == 37


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    texts = hard_texts(6)
    items = [(i, prose(rng, rng.randint(8, 40))) for i in range(20)] + [(20, None), (21, ""), (22, "... !"), (23, "lonely"), (24, texts[3][1]), (24, texts[4][1]), (None, texts[5][1]), (25, texts[3][1])]
    for i, (_, t) in enumerate(items[:10]):
        texts.append((700 + i, f"{prose(rng, 10)}, {t.upper()} Lonely {prose(rng, 5)}"))
    words = lambda t: WORDS.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(k) for k in windows}
    want = []
    for i, t in texts:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit[k : k + n] = [True] * n
                    found |= own
        listed = sorted(str(x) for x in found if x is not None)
        want.append((i, len(w), sum(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), any(hit)))
    docs, bench = documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    ordered = lambda rows: sorted(map(str, map(tuple, rows)))
    assert ordered(decontaminate.digest(docs, bench).collect()) == ordered(want)
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not x[-1] for x in want)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)  # several blocks of the test set
    assert ordered(decontaminate.digest(docs, bench).collect()) == ordered(want)
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.digest(docs.limit(0), bench).count() == 0


def test_suffix_array_and_matches_against_plain_search():
    import pyarrow as pa

    rng = random.Random(21)
    for _ in range(60):
        x = np.append(np.array([rng.randrange(3) for _ in range(rng.randint(0, 60))], dtype=np.int64), 9)
        assert decontaminate.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
    words = lambda k: [f"v{rng.randrange(3)}" for _ in range(k)]
    for _ in range(40):
        items, texts = [words(rng.randint(0, 9)) for _ in range(4)], [words(rng.randint(0, 25)) for _ in range(6)]
        test = decontaminate.TestSet(list(range(4)), [" ".join(x) for x in items], 4)
        for text, (n, covered, found, longest) in zip(texts, decontaminate._found(test, pa.array([" ".join(t) for t in texts])), strict=True):
            hit, own, most = [False] * len(text), set(), 0
            for i, item in enumerate(items):
                size = min(4, len(item))
                for p in range(len(item) - size + 1) if size else ():
                    for q in range(len(text) - size + 1):
                        if item[p : p + size] == text[q : q + size]:
                            k = size
                            while p + k < len(item) and q + k < len(text) and item[p + k] == text[q + k]:
                                k += 1
                            hit[q : q + size] = [True] * size
                            own.add(str(i))
                            most = max(most, k)
            assert (n, covered.tolist(), found, longest) == (len(text), hit, sorted(own), most)


def test_longest_match(spark):
    item = " ".join(f"i{k}" for k in range(30))
    docs = documents(spark, [(1, "x " + " ".join(f"i{k}" for k in range(3, 25)) + " y"), (2, "nothing")])
    found = {r.doc_id: r for r in decontaminate.matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert (found[1].longest, found[1].n_hit) == (22, 22) and [(s.start, s.end) for s in found[1].spans] == [(1, 23)]
    assert found[2].longest == 0


def test_line_dedup(spark):
    rng = random.Random(7)
    own = lambda: prose(rng, 12, 5000)
    texts = [(i, f"{own()}\nDownloaded on day {i} of the year from mirror number {i % 3}\n\nAll rights reserved.\n{own()}") for i in range(6)]
    texts += [(10 + i, texts[0][1]) for i in range(9)]  # equal texts count once
    unique = own()
    texts += [(30 + i, f"{unique}\nextra") for i in range(9)]  # copies alone make nothing recur
    texts += [(50, None), (51, ""), (52, "\n\n"), (None, "All rights reserved."), (60, "word " * 30000)]
    docs = documents(spark, texts)
    got = line_dedup.drop_recurring(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[0].n_dropped == 0 and rows[0].text == texts[0][1]
    for i in range(1, 6):
        assert rows[i].n_dropped == 2 and "reserved" not in rows[i].text and "Downloaded" not in rows[i].text and rows[i].n_lines == 5
    assert rows[30].n_dropped == rows[35].n_dropped == 0
    assert rows[50].text is None and rows[51].text == "" and rows[52].text == "\n\n" and rows[None].text == "All rights reserved."
    assert line_dedup.drop_recurring(docs.limit(0)).count() == 0
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_masks_tokens_with_digits(spark):
    """Hex ids differ in more than their digits."""
    rng = random.Random(11)
    ids = ["7f3a9c", "b81e04", "00ffee", "c0ffee1", "9", "x-1y", "é4ü"]
    texts = [(i, f"{prose(rng, 12, 5000)}\nsession\t{x} was closed by peer\n{x} is gone") for i, x in enumerate(ids)]
    got = line_dedup.drop_recurring(documents(spark, texts)).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {i: 2 * (i > 0) for i in range(len(ids))}


def test_line_dedup_finds_scattered_variables(spark):
    """Sixteen tokens of which three vary, and eight of which three vary (too many)."""
    rng = random.Random(17)
    long = lambda: " ".join(w if k not in (4, 9, 14) else prose(rng, 1, 90000) for k, w in enumerate("the job has ended on node alpha after many hours of work by user root today".split()))
    short = lambda: " ".join(w if k not in (4, 5, 7) else prose(rng, 1, 90000) for k, w in enumerate("this line is about one or two things".split()))
    texts = [(i, f"{long()}\n{short()}\n\nend") for i in range(8)]
    got = line_dedup.drop_recurring(documents(spark, texts)).collect()
    assert {r.doc_id: (r.n_dropped, r.text) for r in got} == {i: (int(i > 0), t if not i else t.split("\n", 1)[1]) for i, t in texts}


def test_pieces_equal_the_library(spark):
    import sentencepiece

    rng = random.Random(8)
    texts = ["", "a", " ", "  two  spaces ", "tab\tnew\nline\n\n x", "日本語 執", "😀😀 é", "a" * 3000, "▁mark▁ here", "\0nul", None, "th" * 200, "x y " * 30000]
    texts += ["".join(rng.choice("ab the éin \n.▁日😀t hoe") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    docs = documents(spark, [*enumerate(texts), (3, texts[3])])
    tokens = pieces.encode(docs)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    for r in tokens.collect():
        assert r.tokens == (None if texts[r.doc_id] is None else sp.encode(texts[r.doc_id]))
    for r in pieces.decoded(tokens).collect():
        assert r.text == (None if texts[r.doc_id] is None else texts[r.doc_id].replace("▁", " "))
    for r in pieces.digest(docs).collect():
        t = texts[r.doc_id]
        assert r.decoded_sha256 == (None if t is None else hashlib.sha256(t.replace("▁", " ").encode()).hexdigest())
    assert pieces.encode(docs.limit(0)).count() == 0


def test_pieces_of_parts_that_share_a_hash(monkeypatch):
    """A collision of cached parts is seen by what the tokens decode to; and wide sort keys give the same order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    codec = pieces.Codec(pieces.Vocabulary(pieces.DEFAULT_MODEL))
    monkeypatch.setattr(pieces, "span_hash", lambda buf, start, end: ((end - start) % 3).astype(np.uint64))
    texts = ["some words of a text", "", None, "other words, longer ones", "日本 é 😀"]
    for text, found in zip(texts, codec.encode(texts), strict=True):
        assert found is None if text is None else (list(memoryview(found[0]).cast("i")), found[1].decode()) == (sp.encode(text), text)


def test_unigram_relaxing():
    """The best path of a unigram model against all paths."""
    vocabulary = pieces.Vocabulary(pieces.DEFAULT_MODEL)
    scores = {"▁": -2.0, "a": -1.0, "b": -1.5, "ab": -2.2, "▁a": -2.5, "ba": -1.1, "aba": -3.0}
    vocabulary.kind, vocabulary.pieces = pieces.UNIGRAM, {p: (i, s) for i, (p, s) in enumerate(scores.items())}
    vocabulary.out = [p.replace("▁", " ").encode() for p in scores]
    codec = pieces.Codec(vocabulary)

    def best(t):
        paths = {0: (0.0, [])}
        for e in range(1, len(t) + 1):
            paths[e] = max((paths[s][0] + scores[t[s:e]], [*paths[s][1], t[s:e]]) for s in range(e) if t[s:e] in scores)
        return paths[len(t)][1]

    for text in ("ab", "abab", "aabbaba", "bab a ab"):
        ids = list(memoryview(next(codec.encode([text]))[0]).cast("i"))
        names = list(scores)
        assert [names[i] for i in ids] == [p for part in re.findall("▁+[^▁]*|[^▁]+", "▁" + text.replace(" ", "▁")) for p in best(part)]


def test_pseudonyms(spark):
    text = "mail hsr.29@mail5.example.com, +1 (988) 555-2485, 3.84.50.105, 4111 1111 1111 1111, DE89 3704 0044 0532 0130 00, 2021-03-04, 04.03.2021, 123-45-6789; not 2021-02-31 1234567890123456 é"
    texts = [(1, text), (2, None), (3, ""), (4, "4111111111111111 again"), (5, text), (6, "9" * 50000), (7, "1.2.3.4."), (None, "none")]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(docs, "key").collect()}
    new = got[1].text
    shape = lambda s: re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", s)))
    mask = lambda s: re.sub(r"9[0-9.]*9(?=, 4)", "ip", s)
    assert shape(new)[:50] == shape(text)[:50] and new.endswith("not 2021-02-31 1234567890123456 é") and got[1].n_replaced == 8
    assert got[5].text == new and got[2].text is None and got[3].text == "" and got[6].n_replaced == 0
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", new)[0].replace(" ", "")
    assert got[4].text.split()[0] == card and luhn(card) == 0 and card != "4111111111111111"
    iban = re.search(r"DE\d\d(?: \d{4}){4} \d\d", new)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    iso, dotted = re.search(r"\d{4}-\d\d-\d\d", new)[0], re.search(r"\d\d\.\d\d\.\d{4}", new)[0]
    assert iso == "-".join(dotted.split(".")[::-1]) and got[7].text.endswith(".")
    assert pseudonyms.pseudonymise(docs.limit(0), "key").count() == 0
    assert "Python" not in pseudonyms.pseudonymise(docs, "key")._jdf.queryExecution().executedPlan().toString()


def luhn(digits):
    return sum((d * 2 - 9 * (d > 4)) if i % 2 else d for i, d in enumerate(map(int, digits[::-1]))) % 10


def test_pseudonyms_are_permutations(spark):
    days = spark.range(73200).select(F.expr("date_format(date_add(date'1900-01-01', cast(id as int)), 'yyyy-MM-dd')").alias("m"))
    addresses = spark.range(20000).select(F.concat(F.lit("10.0."), F.floor(F.col("id") / 256), F.lit("."), F.col("id") % 256).alias("m"))
    mails = spark.range(5000).select(F.concat(F.lit("user"), F.col("id").cast("string"), F.lit("@x.org")).alias("m"))
    for values in (days, addresses, mails):
        found = values.select("m", pseudonyms.pseudonym(F.col("m"), "key").alias("p"), pseudonyms.pseudonym(F.col("m"), "other").alias("q"))
        r = found.agg(F.count("*").alias("n"), F.count_distinct("p").alias("p"), F.count_if(F.col("p") == F.col("q")).alias("same")).first()
        assert r.n == r.p and r.same < r.n / 100


def plain_feistel(value, mask, key, kind):
    """The network over characters, by the definition."""
    alphabets = {"d": "0123456789", "e": "23456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    half = len(value) // 2
    a, b, ka, kb = value[:half], value[half:], mask[:half], mask[half:]
    for i in range(pseudonyms.ROUNDS):
        digest = "".join(hashlib.sha512("|".join([key, kind, str(i), mask, str(n), b]).encode()).hexdigest()[:125] for n in range(2))
        new = ""
        for j, (c, k) in enumerate(zip(a, ka)):
            own = alphabets.get(k)
            new += own[(own.index(c) + int(digest[5 * j : 5 * j + 5], 16)) % len(own)] if own else c
        a, b, ka, kb = b, new, kb, ka
    return a + b


def plain_grid(left, right, a, b, key, kind):
    for i in range(pseudonyms.ROUNDS):
        by = lambda x: int(hashlib.sha256(f"{key}|{kind}|{i}|{x}".encode()).hexdigest()[:14], 16)  # noqa: B023, E731
        left, right = ((left + by(right)) % a, right) if i % 2 == 0 else (left, (right + by(left)) % b)
    return left, right


def plain_pseudonym(value, key):
    if "@" in value:
        local, domain = value.split("@")
        mask = "".join("a" if c in string.ascii_lowercase else "A" if c in string.ascii_uppercase else "d" if c.isdigit() else c for c in local)
        return plain_feistel(local, mask, key, f"email:{domain.lower()}") + "@" + domain
    if re.fullmatch(r"\d{4}-\d\d-\d\d", value):
        day = (datetime.date.fromisoformat(value) - datetime.date(1900, 1, 1)).days
        x, y = plain_grid(day // 305, day % 305, 240, 305, key, "date")
        return str(datetime.date(1900, 1, 1) + datetime.timedelta(x * 305 + y))
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", value):
        areas = [x for x in range(1, 900) if x != 666]
        x, y = plain_grid(areas.index(int(value[:3])), (int(value[4:6]) - 1) * 9999 + int(value[7:]) - 1, 898, 99 * 9999, key, "ssn")
        return f"{areas[x]:03}-{y // 9999 + 1:02}-{y % 9999 + 1:04}"
    if value[0].isalpha():
        country, body = value[:2], value[4:]
        body = plain_feistel(body, "".join("d" if c.isdigit() else "A" for c in body), key, "iban")
        return country + f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02}" + body
    body = plain_feistel(value[:-1], "k" + "d" * (len(value) - 2), key, "card")
    return body + next(c for c in "0123456789" if luhn(body + c) == 0)


def test_pseudonyms_against_plain_networks(spark):
    rng = random.Random(13)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    values = [pick("abcxyzABZ019._+-", rng.randint(1, 64)) + rng.choice(["@mail.example.com", "@X.org"]) for _ in range(120)]
    values += [str(datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73200))) for _ in range(60)]
    values += [f"{rng.choice([1, 665, 667, 899, rng.randint(1, 665)]):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}" for _ in range(60)]
    for _ in range(60):
        body = rng.choice("3456") + pick("0123456789", rng.randint(11, 17))
        values.append(body + next(c for c in "0123456789" if luhn(body + c) == 0))
        body = pick("0123456789ABZ", 4 * rng.randint(3, 7))
        values.append("DE" + f"{98 - int(''.join(str(int(c, 36)) for c in body + 'DE00')) % 97:02}" + body)
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    key = hashlib.sha256(b"secret").hexdigest()
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(docs, "secret").collect()}
    for i, v in enumerate(values):
        assert (got[i].n_found, got[i].text) == (1, plain_pseudonym(v, key)), v


def test_pseudonyms_of_one_domain_share_no_shift(spark):
    names = ["alice", "bobby", "carol", "aaaaa", "aaaab", "zzzzz"]
    got = spark.createDataFrame([(n + "@mail.example.com",) for n in names], "m string").select("m", pseudonyms.pseudonym(F.col("m"), "key").alias("p")).collect()
    shifts = {tuple((ord(b) - ord(a)) % 26 for a, b in zip(r.m.split("@")[0], r.p)) for r in got}
    assert len(shifts) == len(names)
    with pytest.raises(ValueError):
        pseudonyms.pseudonymise(spark.createDataFrame([("x",)], "text string"), "")


def test_pseudonyms_of_long_texts_that_nearly_match(spark):
    texts = ["x@" + "a." * 5000 + "1", "x@" + "aa." * 40000, "a@" * 50000, "1." * 50000, "x" * 100000 + "@a.bc", "a.b@" + "c" * 100000 + ".de", "12-" * 30000, "AB12 " * 20000, "+1 (" * 20000, "x@" + "a." * 5000 + "com"]
    got = pseudonyms.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()
    assert len(got) == len(texts) and all(len(r.text) == len(texts[r.doc_id]) for r in got)


def test_trie_against_edit_distance():
    terms = ["idiot", "moron", "worthless", "scum"]
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 0.99), set())
    rng = random.Random(9)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for x in a:
            new = [row[0] + 1]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "o"])
        w = "".join(w)
        want = min(((distance(w, t), t) for t in terms if distance(w, t) <= (len(t) >= 5)), default=None)
        assert lexicon.trie.match(w) == (want and want[::-1])


def test_wide_characters_are_one_edit():
    """An inserted or substituted character of three or four bytes reaches the trie."""
    import pyarrow as pa

    lexicon = toxicity.Lexicon({"blockhead": 0.99}, set())
    words = ["block\u200bhead", "bloc\u200dkhead", "block\U0001f600head", "bl\U0001f600ckhead", "blo\u20acckhead"]
    for found in toxicity._matches(lexicon, pa.array([f"you {w} there" for w in words])):
        assert [m["term"] for m in found] == ["blockhead"]


def test_matches_against_brute_force():
    """All that stands before the automata lets pass what they match: random edits, scripts, cases, quotation marks, invisible characters."""
    import pyarrow as pa

    terms = ["idiot", "moron", "crétin", "scum", "ärgerlich", "дурачок", "worthless"]
    lexicon = toxicity.Lexicon({**dict.fromkeys(terms, 0.99), "block": 0.99}, {"block"})
    rng = random.Random(14)
    extra = ["", "o", "É", "\u200b", "\u00ad", "\U0001f600", "\u212a", "日", "1", "ı", "\u0301"]
    around = [" ", "“", "”", "«", "»", "…", "—", "'", "-", "\u3000", "\n", "¿", ", ", "(", "\u2028"]

    def edited():
        w = list(rng.choice([*terms, "blocks", "blocked", "block", "plain", "Idiom"]))
        for _ in range(rng.choice([0, 0, 1, 1, 1, 2])):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(extra)
        return rng.choice([str.lower, str.upper, str.title, str])("".join(w))

    def plain_words(text):
        ends = lambda c: not c.isalnum() if c.isascii() else unicodedata.category(c)[0] in "PZ" or unicodedata.category(c) == "Cc"
        for w in "".join(" " if ends(c) else c for c in text).split(" "):
            w = "".join(c for c in w if unicodedata.category(c) != "Cf").lower()
            if w:
                yield w

    def near(a, b):
        if a == b:
            return True
        if len(a) > len(b):
            a, b = b, a
        i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a[i + (len(a) == len(b)) :] == b[i + 1 :]

    texts = ["".join(edited() + rng.choice(around) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    for text, found in zip(texts, toxicity._matches(lexicon, pa.array(texts)), strict=True):
        want = []
        for w in plain_words(text):
            edits = [(int(w != t), t) for t in terms if w == t or (len(t) >= toxicity.FUZZY and near(w, t))]
            edits += [(0, "block")] if w.startswith("block") and len(w) > 5 else []
            if edits:
                want.append(min(edits)[1])
        assert [m["term"] for m in found] == want, text
        assert all(toxicity.visible(text.encode()[m["start"] : m["end"]].decode()) for m in found)


def test_quotations():
    import pyarrow as pa

    lexicon = toxicity.Lexicon({"idiot": 0.99}, set())
    far = "plain things " * 30
    texts = {"you idiot": False, f'“{far} idiot {far}”': True, f'"{far} idiot" it was': True, f'"{far}" idiot': False, "«idiot»": True, "„idiot“": True, '"one\nidiot"': False, "they wrote idiot": True}
    for (text, quoted), found in zip(texts.items(), toxicity._matches(lexicon, pa.array(list(texts))), strict=True):
        assert [m["quoted"] for m in found] == [quoted], text


def test_toxicity(spark):
    rng = random.Random(10)
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = prose(rng, 40).split()
        if toxic:
            words[rng.randrange(40)] = "blockhead"
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    texts += [(1000, "you blokhead there now"), (1001, 'he said "blockhead" once'), (1002, None), (1003, ""), (1004, "calm words " * 20000), (None, "blockhead"), (0, texts[0][1])]
    docs, known = documents(spark, texts), spark.createDataFrame([*labels, (5, None), (None, 1), (8, 0)], "doc_id long, toxic int")
    rows = toxicity.digest(docs, known).collect()
    got = {r.doc_id: r for r in rows}
    truth = dict(labels)
    assert all(got[i].predicted == truth[i] for i in range(400) if got[i].held_out) and len(rows) == len(texts)
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and abs(got[1002].score - toxicity.FLOOR) < 1e-9 and got[1003].score == got[1002].score and not got[None].held_out
    none = toxicity.fit(docs, known.limit(0))
    assert none.weights == {} and toxicity.scores(docs, none).where("score > 0.3").count() == 0
    assert toxicity.clean(docs, toxicity.fit(docs, known)).columns == docs.columns
    assert toxicity.digest(docs.limit(0), known).count() == 0
