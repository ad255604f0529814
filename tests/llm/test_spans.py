"""Secrets, personal data and toxicity on small texts."""

import hashlib
import re
import time

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from crawlops.llm import queries
from crawlops.llm.pii_crf import EXAMPLES, TAGS, Field, Words, best_path, find_personal, labelled, runs_of, spans_of
from crawlops.llm.pii_patterns import IP, base_spans, emails
from crawlops.llm.segments import maximal
from crawlops.llm.secret_scan import blank, find_secrets, scanner
from crawlops.llm.toxicity import segments, toxicity
from tests.conftest import SMALL, rows
from tests.llm.conftest import ODD

PATTERN = public_tokenizers.PATTERN
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain_secrets(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32])


def plain_personal(text):
    found = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        checked = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and checked % 10 == 0:
            found.append((2, *m.span()))
    phones = re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
    return found + [(3, *m.span()) for m in phones if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


SECRET_PARTS = ["token", "TOKEN", "api_key", "apikey", "password", '"', "'", " ", "=", ":", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef" * 4, "0123456789abcdef", "abc", "Zz9", ".", "ſecret", "é", "\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SECRET_PARTS), max_size=12).map("".join))
def test_base_secrets(text):
    assert [s for s in scanner(queries.BYTE_RANKS, PATTERN)(text) if s[1] < 3] == plain_secrets(text)


@settings(max_examples=500, deadline=None)
@given(st.text("a@.1-2+ 25()4é", max_size=30))
def test_base_personal(text):
    assert base_spans(text) == plain_personal(text)


def test_long_texts_take_linear_time():
    assert emails("a" * 300_000 + " b@c") == [] and IP.search("1" * 300_000) is None
    assert base_spans("9" * 200_000 + "@" * 100) == []


def test_random_strings_and_known_forms():
    scan = scanner(queries.BYTE_RANKS, PATTERN)
    kinds = lambda t: {k for _, k, _ in scan(t)}
    assert 3 in kinds("key Xq9vK2mZr7Tj4LwPbN8s here") and 3 in kinds("ghp_x8Kq2ZrT7vLm4NpW9sJd3FbY6cHg")
    for known in ("123e4567-e89b-12d3-a456-426614174000", "internationalization_of_names", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "schheitverkeitlichungen", "20240102030405060708", "ThisIsALongClassName"):
        assert 3 not in kinds(f"see {known} there"), known


def test_random_letters_and_grouped_keys():
    import random
    import string

    scan, dice = scanner(queries.BYTE_RANKS, PATTERN), random.Random(5)
    found = lambda t: [t[s:e] for s, k, e in scan(t) if k == 3]
    for letters in (string.ascii_lowercase, string.ascii_uppercase):
        for size in (16, 24, 40):
            made = ["".join(dice.choices(letters, k=size)) for _ in range(100)]
            assert sum(found(f"see {m} there") == [m] for m in made) >= 95
    made = ["-".join("".join(dice.choices(string.ascii_uppercase, k=5)) for _ in range(4)) for _ in range(100)]
    assert sum(bool(found(m)) for m in made) >= 85
    assert found("key XKQJZ-88213-PQWMV end") == ["XKQJZ-88213-PQWMV"] and found("xkqjzvwmplkjhgfd1234") == ["xkqjzvwmplkjhgfd1234"]
    for name in ("MAX_BUFFER_SIZE_LIMIT", "getElementsByTagName2", "user/documents/downloads/archive", "2024-01-02-0304-050607", "token_count_per_document"):
        assert found(name) == [], name


def test_words_beside_a_random_part():
    import random
    import string

    scan, dice = scanner(queries.BYTE_RANKS, PATTERN), random.Random(6)
    for before in ("session_identifier=", "authorization_bearer=", "client_credentials=", "user/documents/downloads/archive/"):
        for size in (16, 20, 24):
            made = ["".join(dice.choices(string.ascii_letters + string.digits, k=size)) for _ in range(100)]
            spans = [[(s, e) for s, k, e in scan(before + m) if k == 3] for m in made]
            assert all(len(f) == 1 and f[0][1] == len(before) + size and f[0][0] <= len(before) for f in spans), before
    assert scan("session_identifier=20240102030405060708") == []


def test_secret_tables(spark, odd, nothing):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    names = ("assign", "access", "hex")
    for r in queries.QUERIES["op3_secret_scan"](spark, SMALL).collect():
        wanted = plain_secrets(texts[r["doc_id"]])
        listed = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in wanted)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in wanted) for i in range(3)]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == [s for s in listed.split(",") if s]
    found = find_secrets(odd, queries.BYTE_RANKS, PATTERN)
    assert found.count() == len(ODD) and found.where("n_hex = 1").count() == 1
    assert find_secrets(nothing, queries.BYTE_RANKS, PATTERN).count() == 0


def test_blank():
    assert blank("abcdefgh", [(1, 0, 3), (2, 2, 4), (6, 1, 8)], "*") == "a*ef*"


def test_personal_tables(spark, odd, nothing):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    names = ("email", "ip", "card", "phone")
    for r in queries.QUERIES["op6_personal_data"](spark, SMALL).collect():
        wanted = plain_personal(texts[r["doc_id"]])
        listed = [f"{names[k]}:{s}:{e}" for k, s, e in wanted]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert r["spans"].split(",")[: len(listed)] == (listed or [""])[: len(listed)]
    found = {r["doc_id"]: r for r in find_personal(odd).collect()}
    assert found[9]["n_email"] == found[9]["n_ip"] == found[9]["n_phone"] == 1 and found[2]["spans"] == ""
    assert find_personal(odd).count() == len(ODD) and find_personal(nothing).count() == 0


def decoded(field, text):
    found = []
    for words, at, group in runs_of(text):
        tags = field.decode([np.stack([field.scores(words, at + k) for k in range(len(group))])])[0]
        found += [(kind, text[s:e]) for kind, s, e in spans_of(text, group, tags)]
    return found


def test_field_learns_its_table_and_more():
    field = Field()
    for line in EXAMPLES:
        words, tags = labelled(line)
        wanted, own = [], None
        for word, tag in zip(words, tags):
            if TAGS[tag][0] == "B":
                own = [TAGS[tag][2:], word]
                wanted.append(own)
            elif TAGS[tag][0] == "I":
                own[1] += " " + word
        assert decoded(field, " ".join(words)) == [tuple(w) for w in wanted], line
    assert decoded(field, "please call me at 555-321-7654, thanks") == [("tel", "555-321-7654")]
    assert decoded(field, "my ssn is 321-54-9876 .") == [("ident", "321-54-9876")]
    assert decoded(field, "in 1850 and 1860 they sold 12 of 40") == []


def test_batched_paths_are_best_paths():
    field, dice = Field(rounds=5), np.random.default_rng(1)
    here = [dice.normal(size=(n, len(TAGS))) * 2 for n in (1, 2, 3, 3)]
    steps = field.steps + field.allowed
    for scores, tags in zip(here, field.decode(here)):
        best, top = None, -np.inf
        for path in np.ndindex(*[len(TAGS)] * len(scores)):
            total = scores[range(len(path)), path].sum() + sum(steps[a, b] for a, b in zip((0, *path), (*path, 0)))
            if total > top:
                best, top = path, total
        assert tuple(tags) == best


def test_spans_with_words_of_letters():
    field = Field()
    for text, wanted in (
        ("the iban is GB29 NWBK 6016 1331 9268 19, thanks", ("ident", "GB29 NWBK 6016 1331 9268 19")),
        ("iban NL91 ABNA 0417 1643 00 please", ("ident", "NL91 ABNA 0417 1643 00")),
        ("phone : \u0660\u0663\u0660 \u0669\u0660\u0661\u0668\u0662\u0660 now", ("tel", "\u0660\u0663\u0660 \u0669\u0660\u0661\u0668\u0662\u0660")),
        ("My name is Robert Fischer, I think", ("name", "Robert Fischer")),
        ("I live at 14 Church Road in town", ("addr", "14 Church Road")),
    ):
        assert decoded(field, text) == [wanted]


def test_lanes_give_the_whole_best_path():
    field, dice = Field(rounds=5), np.random.default_rng(2)
    steps = field.steps + field.allowed
    for scale, bond in ((2.0, 0.0), (0.1, 3.0)):  # the second: paths that agree only after many words
        tied = steps + bond * np.eye(len(TAGS))
        here = dice.normal(size=(200, len(TAGS))) * scale
        best, came = here[0] + tied[0], []
        for row in here[1:]:
            ways = best[:, None] + tied
            came.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        tags = [(best + tied[:, 0]).argmax()]
        for back in came[::-1]:
            tags.insert(0, back[tags[0]])
        for size, warm in ((256, 32), (16, 4), (7, 2), (1, 1)):
            assert best_path(here, tied, size, warm).tolist() == tags


def test_scores_by_word_are_those_of_features():
    field = Field()
    texts = [line.replace("{", "").replace("}", "").split() for line in EXAMPLES[::5]] + [["^"], ["$", "$"], []]
    for words, tags in zip(texts, Words(field).tags(texts)):
        runs = runs_of(" ".join(words))
        wanted = [field.decode([np.stack([field.scores(own, k) for k in range(len(own))])])[0] for own, _, _ in runs]
        assert tags.tolist() == [t for row in wanted for t in row]


@given(st.lists(st.integers(-4, 4), max_size=14))
def test_segments_are_the_maximal_ones(scores):
    def best(low, high):
        """Recursive definition: the best segment, then the same on both sides of it."""
        spans = [(sum(scores[a:b]), -(b - a), -a) for a in range(low, high) for b in range(a + 1, high + 1) if sum(scores[a:b]) > 0]
        if not spans:
            return []
        total, size, at = max(spans)
        return [*best(low, -at), total, *best(-at - size, high)]

    assert sorted(segments(np.array(scores, dtype=float))) == sorted(map(float, best(0, len(scores))))


def test_segments_in_linear_time():
    """Sums that fall, rise, and wander: none takes a second for hundred thousand tokens."""
    dice = np.random.default_rng(1)
    size = 300_000
    for scores in (np.tile([1.0, -2.0], size // 2), np.tile([2.0, -1.0], size // 2), dice.normal(size=size), dice.normal(-0.3, 1, size)):
        began = time.process_time()
        found = maximal(scores)
        assert time.process_time() - began < 3
        ends = np.cumsum(scores)
        assert all(a < b and high > low and np.isclose(ends[b - 1], high) for a, b, low, high in found[:: len(found) // 50 + 1])


def test_long_lines_are_scanned_fast():
    scan = scanner(queries.BYTE_RANKS, PATTERN)
    line = "_".join(["word", "x7Qz"] * 20_000)
    began = time.process_time()
    scan(line)
    assert time.process_time() - began < 20


def test_toxicity_of_planted_words(spark):
    import random

    dice = random.Random(3)
    vocabulary = ["w" + "".join(dice.choice("abcdefg") for _ in range(4)) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        words = dice.choices(vocabulary, k=dice.randrange(5, 80))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(words) // 30):
                words.insert(dice.randrange(len(words)), dice.choice(["vileword", "badword", "uglyword"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in found) >= 0.97 * len(found) and all(0 <= r["score"] <= 1 for r in found)


def test_toxicity_of_odd_rows(spark, odd, nothing):
    kinds = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(1, 1, 0), (6, None, 1), (9, 1, None), (None, 1, 1), (99, 0, 1)], kinds)
    for known in (labels, labels.limit(0)):
        found = toxicity(odd, known)
        assert found.count() == len(ODD) and found.where("score is null or held_out is null").count() == 0
        assert toxicity(nothing, known).count() == 0
    assert rows(toxicity(odd, labels.limit(0)), "score") == [(0.5,)] * len(ODD)
