"""Secret scans against Python's regular expressions."""

import hashlib
import random
import re
import string

from factloom.llm import secrets
from factloom.llm.common import table
from factloom.llm.queries import op9_secrets

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def shown(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables hold no secret
    rows = {r["doc_id"]: r for r in op9_secrets(spark, sf).collect()}
    found = 0
    for d in table(spark, sf, "documents").collect():
        b, r = base(d["text"]), rows[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(shown(b).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in b) for k in range(3)]
        assert set(shown(b).split(",")) <= set(r["spans"].split(",")) or not b
        found += len(b)
    assert found


def test_edges(spark):
    texts = [
        None, "", "é" * 5 + "token=abcdef AKIA" + "A1" * 8, "secret: token = abcdefgh", "API_KEY:'abc-de' PassWd = \"qwerty\"",
        "AKIAAKIA" + "B" * 11, "AKIA" + "B" * 15, "0123456789abcdef0123456789abcdef" * 2, "token==abcdef", "😀😀 apikey=zzzzzz\n" * 3,
        "x" * 100_000 + " token: " + "a" * 50_000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "secrets int, text string").withColumnRenamed("secrets", "doc_id")
    model = secrets.train(secrets.labelled_samples(spark))
    for r in secrets.scan(df, model).collect():
        assert [tuple(s) for s in r["secrets"] if s["kind"] < 3] == base(r["text"]), r["text"]
    assert secrets.scan(df.limit(0), model).count() == 0


def test_models_tell_random_from_ordinary(spark):
    model = secrets.train(secrets.labelled_samples(spark))
    bad = ["Zk3qP9vXw2LmT8aRb5NcYd7Q", "sk_live_9aF3kQz81LmPxT0vBn42", "QmFzZTY0IGlzIGZ1bi4xMjM0NTY3ODk"]
    good = ["internationalisation", "getCustomerAccountBalance", "/usr/local/lib/python/site-packages", "thnttionwhthtibleeren", "some-long-hyphenated-name", "=" * 40, "-" * 60]
    df = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(bad + good)], "doc_id int, text string")
    hits = {r["doc_id"]: [s["kind"] for s in r["secrets"]] for r in secrets.scan(df, model).collect()}
    assert all(3 in hits[i] for i in range(len(bad)))
    assert not any(hits[i] for i in range(len(bad), len(bad + good)))


def test_names_are_not_secrets(spark):
    """UUIDs and digests in groups, which the samples do not hold, stay; of dashed keys that are no such names nearly all are found."""
    model = secrets.train(secrets.labelled_samples(spark))
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    names = ["123e4567-e89b-12d3-a456-426614174000"] + ["-".join(map(digits, (8, 4, 4, 4, 12))) for _ in range(150)]
    names += [n.upper() for n in names[:50]] + ["-".join(digits(8) for _ in range(5)) for _ in range(50)]
    keys = [f"{kind}{''.join(rng.choice(string.ascii_letters + string.digits) for _ in range(36))}" for kind in ("ghp_", "sk_live_", "AIza", "xoxb-") for _ in range(25)]
    df = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(names + keys)], "doc_id int, text string")
    hits = {r["doc_id"]: bool(r["secrets"]) for r in secrets.scan(df, model).collect()}
    wrong, missed = [t for i, t in enumerate(names) if hits[i]], [t for i, t in enumerate(keys, len(names)) if not hits[i]]
    assert len(wrong) <= 0.04 * len(names) and "123e4567-e89b-12d3-a456-426614174000" not in wrong, wrong
    assert not missed, missed


def markov(text, model, threshold=0.35):
    """Spans of the models by plain Python."""
    n, limit, out = len(secrets.ALPHABET), round(1000 * threshold), []

    def excess(s):
        at = [secrets.ALPHABET.index(c) for c in s]
        return [model[a * n + b] - limit for a, b in zip(at, at[1:])]

    def stretches(s):
        total = best = begin = end = part = 0
        found = []
        for i, x in enumerate(excess(s)):
            if s[i] in secrets.SEPARATORS:
                part = i + 1
            if total <= 0:
                begin = part
            now = total + x
            if now <= max(0, best - secrets.LEAST_EXCESS):
                if best >= secrets.LEAST_EXCESS:
                    found.append((begin_of_best, end))
                total = best = 0
                continue
            if now > best:
                best, end, begin_of_best = now, i + 2, begin
            total = now
        if best >= secrets.LEAST_EXCESS:
            found.append((begin_of_best, end))
        wide = []
        for a, b in found:
            while b < len(s) and s[b - 1] not in secrets.SEPARATORS and s[b] not in secrets.SEPARATORS:
                b += 1
            if b - a >= secrets.LEAST and (a, b) not in wide:
                wide.append((a, b))
        return wide

    for run in re.finditer(secrets.RUN, text):
        at, pieces = run.start(), []
        for a, _, b in base(text):
            if a < run.end() and run.start() < b:
                if a > at:
                    pieces.append((at, a))
                at = max(at, b)
        pieces.append((at, run.end()))
        for a, b in pieces:
            s = text[a:b]
            if len(s) < secrets.LEAST:
                continue
            if sum(excess(s)) > 0:
                out.append((a, b))
                continue
            wide = stretches(s)
            parts = [m.span() for m in re.finditer(f"[^{secrets.SEPARATORS}]{{{secrets.LEAST},}}", s) if sum(excess(m[0])) > 0]
            out += [(a + x, a + y) for x, y in wide + [p for p in parts if not any(w[0] <= p[0] and p[1] <= w[1] for w in wide)]]
    return sorted(out)


def test_spans_of_the_models_equal_plain_python(spark):
    model = secrets.train(secrets.labelled_samples(spark))
    rng = random.Random(9)
    words = "settings organization repository webhooks library internationalisation customer".split()

    def some():
        kind = rng.randrange(5)
        if kind == 0:
            return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randint(8, 40)))
        if kind == 1:
            return "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((8, 12, 24, 30))))
        if kind == 2:
            return "AKIA" + "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(16))
        return rng.choice(words)

    texts = []
    for _ in range(250):
        texts.append(" ".join("".join(some() + rng.choice("/_=-+é" if rng.random() < 0.9 else " ") for _ in range(rng.randint(1, 6))) for _ in range(3)))
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()
    found = 0
    for r in rows:
        got = sorted((s["start"], s["end"]) for s in r["secrets"] if s["kind"] == 3)
        assert got == markov(r["text"], model), r["text"]
        found += len(got)
    assert found > 200


def test_redact_is_exact(spark):
    model = secrets.train(secrets.labelled_samples(spark))
    texts = ["a token=abcdef0123456789abcdef0123456789 b AKIA" + "Q" * 16, "none", None, "password: hunter22"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {r["doc_id"]: r["text"] for r in secrets.redact(secrets.scan(df, model)).collect()}
    assert out == {0: "a <secret> b <secret>", 1: "none", 2: None, 3: "<secret>"}


def test_ordinary_text_does_not_hide_a_joined_secret(spark):
    model = secrets.train(secrets.labelled_samples(spark))
    rng = random.Random(3)
    signs = string.ascii_letters + string.digits
    of = lambda n, also="": "".join(rng.choice(signs + also) for _ in range(n))
    path, after = "com/organization/repository/settings/webhooks/", "/settings/organization/repository"
    rows, least = [], []
    for n in (20, 24, 32):
        for _ in range(100):
            s = of(n)
            rows += [(s, s), (path + s, s), ("AWS_SECRET_ACCESS_KEY=" + s, s), (path + s + after, s)]
    mixed = [of(40, "+/") for _ in range(100)]
    for s in mixed:
        rows += [(path + s + after, s)]
    df = spark.createDataFrame([(i, f"see {t} there") for i, (t, _) in enumerate(rows)], "doc_id int, text string")
    hits = {r["doc_id"]: [(s["start"] - 4, s["end"] - 4) for s in r["secrets"] if s["kind"] == 3] for r in secrets.scan(df, model).collect()}
    missed = [t for i, (t, s) in enumerate(rows) if not any(a <= t.index(s) and t.index(s) + len(s) <= b for a, b in hits[i])]
    assert len(missed) <= 0.02 * len(rows), missed


def test_joined_secrets_are_redacted_apart_from_what_is_ordinary(spark):
    model = secrets.train(secrets.labelled_samples(spark))
    a, b, k = "Zk3qP9vXw2LmT8aRb5NcYd7Q", "h7Gd2KxT0pWz5VbQ9sLfRj4M", "AKIA" + "Q1" * 8
    path = "com/organization/repository/settings/webhooks/organization/repository/settings/"
    texts = [path + a, f"{path}{a}/{path}{b}", f"{k}/{a}", f"{path}{k}/settings/{a}", path + "none/at/all", f"é {path}{a} é", f"{path}{a} {path} {b}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {r["doc_id"]: r["text"] for r in secrets.redact(secrets.scan(df, model)).collect()}
    for i, text in enumerate(texts):
        assert not any(s in out[i] for s in (a, b, k)), out[i]
    assert out[0] == f"{path}<secret>" and out[4] == texts[4] and out[5] == f"é {path}<secret> é"
    assert out[2].startswith("<secret>")


def test_labelled_set(spark):
    """Recall and precision on strings that the samples don't hold, in sentences; no base pattern fits them."""
    model = secrets.train(secrets.labelled_samples(spark))
    rng = random.Random(11)
    signs = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits)
    random_ones = ["".join(rng.choice(signs[i % 4]) for _ in range(rng.randint(24, 60))) for i in range(400)]
    parts = "order invoice kitchen bicycle harbour mountain yellow windows quarter journal teacher painter orchestra village railway compiler scheduler keyboard printer balcony".split()
    joins = ("_", "-", "/", "", "__")
    ordinary = []
    for i in range(400):
        some = [rng.choice(parts) for _ in range(4)]
        if i % 3 == 1:
            some = [w.title() for w in some]
        if i % 7 == 3:
            some = [w.upper() for w in some]
        name = joins[i % 5].join(some) + (str(rng.randint(1, 99)) if i % 4 == 0 else "")
        ordinary.append(name if len(name) >= 20 else name + "_" + "_".join(some))
    rows = [(i, f"the value {t} was set") for i, t in enumerate(random_ones + ordinary)]
    hits = {r["doc_id"]: any(s["kind"] == 3 for s in r["secrets"]) for r in secrets.scan(spark.createDataFrame(rows, "doc_id int, text string"), model).collect()}
    caught, wrong = sum(hits[i] for i in range(400)), sum(hits[i] for i in range(400, 800))
    assert caught >= 0.97 * 400, caught
    assert caught / (caught + wrong) >= 0.97, wrong


def test_columns_of_any_name_stay(spark):
    names = ["_run", "_assign", "_access", "_hex", "_base", "_runs", "row"]
    df = spark.createDataFrame([(1, "token=abcdef", *range(7), "x")], "doc_id int, text string, " + ", ".join(f"{c} int" for c in names) + ", secrets string")
    (r,) = secrets.scan(df, secrets.train(secrets.labelled_samples(spark))).collect()
    assert [r[c] for c in names] == list(range(7)) and [tuple(s) for s in r["secrets"]] == [(0, 0, 12)]
