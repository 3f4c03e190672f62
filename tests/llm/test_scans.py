import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from palaver.llm import decontaminate, secret_scan
from palaver.llm.license_scan import NOTICES, PHRASES, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_base_phrases_equal_a_plain_scan(frame):
    texts = [
        None, "", "CC-BY cc by CC,BY", "The MIT License; mit\nlicense MIT licensed", "GNU GENERAL public license " * 3,
        "gnu general public licence", "É apache license ÉAPACHE LICENSE", "mit " * 2000 + "license", "cc by" + " cc" * 50,
    ]
    rows = [(None if i == 2 else i // 2, t, "x") for i, t in enumerate(texts)]
    got = scan_licenses(frame(rows, "doc_id long, text string, label string")).collect()
    seen = {}
    for r in got:
        s = seen.setdefault(r.row, (r.doc_id, r.n_words, []))
        if r.base:
            s[2].append((r.label, r.first_word))
    want = []
    for doc_id, text, _ in rows:
        words = WORD.findall(lower(text or ""))
        places = []
        for phrase, label in PHRASES:
            p = phrase.split()
            places += [(label, i) for i in range(len(words)) if words[i : i + len(p)] == p]
        want.append((doc_id, len(words), sorted(places)))
    assert sorted(((a, b, sorted(c)) for a, b, c in seen.values()), key=str) == sorted(want, key=str)


def test_broken_notice_is_verified_and_chance_words_are_not(frame):
    notice = NOTICES[2][0].split()
    broken = notice[:10] + ["so", "to", "say"] + notice[10:]
    rows = [(1, "Look: " + " ".join(broken)), (2, " ".join(notice[:8])), (3, "any word " * 30)]
    got = {(r.doc_id, r.label) for r in scan_licenses(frame(rows, "doc_id long, text string")).collect() if r.label}
    assert (1, NOTICES[2][1]) in got and not any(d == 3 or (d == 2 and n == NOTICES[2][1]) for d, n in got)


def test_no_rows(frame, spark):
    empty = frame([], "doc_id long, text string")
    assert scan_licenses(empty).count() == 0
    assert secret_scan.scan_blobs(empty).findings.count() == 0
    items = frame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert decontaminate.leaks(empty, items).count() == 0
    assert decontaminate.leaks(frame([(1, "a b c d e f g h i j k")], "doc_id long, text string"), empty.toDF("item_id", "text")).count() == 0


SECRETS = [
    None, "", 'password = "abcdef12" x', "😀 token: aaaaaa", "secret=token: abcdefgh", "secret=abc token=abcdefg",
    "AKIA" + "A" * 15, "AKIA" + "A" * 16 + " " + "0" * 23 + " " + "f" * 24, "PASSWD:=x=====", "api_key='k' apikey=kkkkkkkkk",
    "token==abcde" * 40, "AKIAAKIA" + "B" * 20 + "a" * 30,
]


def plain_spans(text):
    out = []
    for n, r in enumerate(secret_scan.RULES):
        for m in re.finditer(r.pattern, text or ""):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), n, r.kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def test_secrets_equal_a_plain_scan(frame):
    rows = [(i % 5 or None, t, "spans") for i, t in enumerate(SECRETS * 2)]
    docs = frame(rows, "doc_id long, text string, blob string").drop("blob")
    found = secret_scan.scan_blobs(docs).findings
    got = secret_scan.findings_by_path(docs, found).select("doc_id", secret_scan.written(F.col("spans")).alias("s")).collect()
    want = [(d, ",".join(plain_spans(t))) for d, t, _ in rows]
    assert sorted(((r.doc_id, r.s) for r in got), key=str) == sorted(want, key=str)


def test_ledger_scans_only_unseen_pairs(frame, spark):
    docs = frame([(i, t) for i, t in enumerate(SECRETS)], "doc_id long, text string")
    first = secret_scan.scan_blobs(docs.where("doc_id < 6"), rules=secret_scan.RULES[:2])
    ledger = secret_scan.Ledger(
        spark.createDataFrame(first.scanned.collect(), first.scanned.schema),
        spark.createDataFrame(first.findings.collect(), first.findings.schema),
    )
    assert secret_scan.scan_blobs(docs.where("doc_id < 6"), rules=secret_scan.RULES[:2], ledger=ledger).scanned.count() == 0
    second = secret_scan.scan_blobs(docs, ledger=ledger)
    old = {(bytes(r.blob), r.rule) for r in ledger.scanned.collect()}
    new = {(bytes(r.blob), r.rule) for r in second.scanned.collect()}
    assert not old & new
    both = ledger.findings.unionByName(second.findings)
    whole = secret_scan.scan_blobs(docs).findings
    assert sorted(map(str, both.collect())) == sorted(map(str, whole.collect()))


def test_leaks_with_substitutions(frame):
    item = [f"w{i}" for i in range(30)]
    swapped = [("zz" if i in (4, 13, 22, 27) else w) for i, w in enumerate(item)]
    rows = [
        (1, "before " + " ".join(item) + " after"),
        (2, "x y z " + " ".join(swapped).upper()),
        (3, " ".join(item[8:20])),
        (4, " ".join(item[:9])),
        (5, " ".join(reversed(item))),
        (None, None),
        (7, ""),
        (None, " ".join(item) + ", " + " ".join(item)),
        (1, "before " + " ".join(item) + " after"),
    ]
    docs = frame([(d, t, "item") for d, t in rows], "doc_id long, text string, item string")
    items = frame([(9, " ".join(item)), (10, None), (11, "too short"), (None, "q " * 40)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item, r.first_word) for r in decontaminate.leaks(docs, items).collect()), key=str)
    assert got == sorted([(1, 9, 1), (1, 9, 1), (2, 9, 3), (3, 9, 0), (None, 9, 0)], key=str)


def test_parts_of_one_diagonal_are_judged_alone(frame):
    item = [f"i{k}" for k in range(50)]
    both = item[:12] + [f"x{k}" for k in range(26)] + item[38:]
    chance = item[:12] + [f"y{k}" for k in range(28)] + item[40:]
    thin = [w if k % 3 else f"z{k}" for k, w in enumerate(item)]
    rows = [(1, " ".join(both)), (2, " ".join(["a", *chance, "b"])), (3, " ".join(thin)), (4, " ".join(item[:7] + thin[:1] * 43))]
    docs, items = frame(rows, "doc_id long, text string"), frame([(1, " ".join(item))], "item_id long, text string")
    got = decontaminate.leaks(docs, items).collect()
    assert sorted((r.doc_id, r.first_word, r.n_aligned, r.n_equal) for r in got) == [(1, 0, 50, 24), (2, 1, 50, 22)]


def test_masks_hit_every_allowed_substitution():
    for size in (10, 12, 16):
        for lost in combinations(range(size), size // 4):
            places = ((at, m) for m in decontaminate.MASKS for at in range(size - m[-1]))
            assert any(all(at + i not in lost for i in m) for at, m in places), (size, lost)


def brute_leak(text, item):
    for shift in range(1 - len(item), len(text)):
        low, high = max(shift, 0), min(shift + len(item), len(text))
        same = [text[i] == item[i - shift] for i in range(low, high)]
        if any(4 * sum(same[i:j]) >= 3 * (j - i) for i in range(len(same)) for j in range(i + 10, len(same) + 1)):
            return True
    return False


def test_leaks_equal_brute_force(frame):
    rng = random.Random(6)
    items = [[f"w{rng.randrange(400)}" for _ in range(n)] for n in (9, 10, 11, 12, 15, 16, 17, 20, 24, 40)]
    texts = []
    for item in items:
        for lost in (len(item) // 4, len(item) // 4 + 1):
            for _ in range(6):
                gone = set(rng.sample(range(len(item)), lost))
                texts.append(["a", *(f"x{k}" if k in gone else w for k, w in enumerate(item)), "b"])
        texts.append([f"x{k}" if k % 4 == 3 else w for k, w in enumerate(item)])
    docs = frame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = frame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(i, j) for i, t in enumerate(texts) for j, item in enumerate(items) if brute_leak(t, item)}
