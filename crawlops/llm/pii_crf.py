"""Personal data of free form: a linear-chain conditional random field over word shapes.

Every word of a text may belong to a span, and the best labels of the whole text are found
together.  Texts lie in one row with words between them that are surely plain; stretches of
that row are decoded side by side in numpy, and joined where they agree (see ``best_path``).
What a word adds to the scores is looked up once per word.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlops.llm.pii_patterns import KINDS, base_spans
from crawlops.llm.texts import held, small_batches

# Training table: {words|kind} marks a span, anything else is plain.  Kinds beyond the fixed forms.
EXAMPLES = """
call me at {555-123-4567|tel} after six
my number is {(415) 555-2671|tel} , leave a message
phone : {020 7946 0958|tel} or write
tel {030 901820|tel} in the morning
reach us under {06 12 34 56 78|tel} today
dial {800.555.0199|tel} for help
fax {555 867 5309|tel} or visit
mobile {0171 2345678|tel} at any time
telephone : {(212) 555-0147|tel}
her phone is {202-555-0173|tel}
cell {919-555-0102|tel} , thanks
ring {01632 960983|tel} and ask for him
téléphone {01 42 68 53 00|tel} le matin
teléfono {91 411 11 11|tel} por la tarde
telefon {089 636 48018|tel} am abend
ssn {078-05-1120|ident} on file
social security number {219-09-9999|ident} was given
her ssn is {457-55-5462|ident} and more
ssn : {123-45-6789|ident}
social security {987-65-4320|ident} of the holder
iban {DE89370400440532013000|ident} for the transfer
account {GB29NWBK60161331926819|ident} at the bank
iban : {FR1420041010050500013M02606|ident}
passport {C01X00T47|ident} expires soon
passport number {L898902C3|ident} issued
iban {GB29 NWBK 6016 1331 9268 19|ident} for rent
iban : {NL91 ABNA 0417 1643 00|ident} at the bank
account {DE89 3704 0044 0532 0130 00|ident} of the firm
pay to {FR14 2004 1010 0505 0001 3M02 606|ident} today
transfer to iban {ES91 2100 0418 4502 0005 1332|ident} now
iban {BE71 ABNA 9616 9231 1769|ident} was used
account {GB82 WEST 1234 5698 7654 32|ident} is mine
passport {AB 1234567|ident} expires soon
passport number {XK 4456789|ident} was lost
my name is {John Smith|name} and i live here
her name is {Maria Garcia|name} , she said
his name was {Peter Brown|name} then
the name is {Anna Schmidt|name}
i am called {Paul Martin|name} at home
signed by {Laura Rossi|name} in person
dear {Susan Miller|name} , thank you
dear Mr {Thomas Baker|name} , we write
ask for Mr {Henry Ford|name} at the desk
we met Mrs {Alice Cooper|name} there
speak to Dr {Karen White|name} today
Ms {Julia Stone|name} called
contact {Jane Doe|name} for more
name : {David Jones|name}
Name : {Claire Dupont|name}
Herr {Klaus Weber|name} ist da
Frau {Petra Wolf|name} kommt
je m'appelle {Marie Dubois|name} et vous
me llamo {Carlos Lopez|name} y vivo
mein Name ist {Hans Becker|name} und ich
my name is {Ana Maria Silva|name} from here
customer {Emma Clark|name} of the firm
he lives at {221 Baker Street|addr} in town
address : {10 Downing Street|addr} , second floor
send to {1600 Pennsylvania Avenue|addr} today
our office is at {350 Fifth Avenue|addr} now
home address {42 Old Mill Road|addr} near us
we moved to {7 Park Lane|addr} in may
come to {18 High Street|addr} at noon
ship to {55 Sunset Boulevard|addr} please
she lives at {9 Elm Drive|addr} alone
wohnt in der {Hauptstraße 12|addr} oben
Adresse : {Bahnhofstraße 5|addr} in der Stadt
Anschrift {Goethestrasse 27|addr} hier
habite {12 rue Victor Hugo|addr} depuis
adresse : {8 avenue Foch|addr} en ville
vive en {Calle Mayor 15|addr} con ella
The United States of America and the House
In New York on Monday the President said
Is and the Order of the day
Der Hund und die Katze im Haus
Die Stadt hat eine Straße und der Weg ist lang
La ville et la rue de la mer
El mundo es grande . La casa
The Street was long . Chapter One of the Book
Dear friends , all is well
my name is on the list
the name of the road is not known
In the street and on the avenue they walked
ISO and UTF and HTTP are names
the bank in USA or UK said NO
Contact us for more . Write to the office
She went . He said . They came . We saw
Good Good Good Good Good Good Good Good
This This This This ist ist ist and so on
yes . Then . After that . Zu . Onen . Haste makes
end of it . Thus . Ours in the end
is in . Ershe . Onat in and at
Well Well . Stop . Stop . Stop . Go . Go
Chapter Chapter Chapter is is is
and Onda Onda Onda Onda Onda Onda Onda Onda Onda
Élan Élan Élan Élan Élan Élan Élan Élan Élan tout
Schön Schön Schön Schön Schön Heim Heim Heim Heim Heim so
the end . Mira Mira Mira Mira Mira Mira Ver Ver Ver Ver and
le petit . Enfin . Nous sommes
to go . To . By To . By To . By hand
12 men on the road and 7 of them left
Copyright the Free Software Foundation and others
write to {bob@localhost|mail} please
mail {alice@intranet|mail} about it
send it to {root@server|mail} now
contact {jane.doe@mailhost|mail} for more
order 4711 was shipped on 2024-01-02
the year 1999 and the year 2024
page 12 of 30 in volume 3
version 1.2.3 came out in 2021
he paid 12.50 and got 3 items
about 250,000 people in 1848
at 10:30 on 12/05/2020 in room 101
chapter 7 verse 14
items 1 2 3 4 5 6 7 8 9 10
between 100 and 200 or 300
from 9807915762804490 and 4845168114407329
see 10.1000/182 and 978-3-16-148410-0
the score was 21-14 in 2003
code 9b0b3c6a43eb78aa99cbd7049c572391524f37a8 here
token = 04dbebab91ab85687d33eeaaf9ac699e1188f962 end
at 192.168.0.1 or 10.0.0.7 the host
in 1914-1918 and 1939-1945
apache license version 2.0 of 2004
temperature 21.5 pressure 1013.25
x1 x2 x3 and a1 b2
2 x 4 is 8
12 345 678 people
0.5 0.25 0.125
1,2 3,4 5,6
20 000 lieues 80 jours
1990 2000 2010 2020
figure 3.14 table 2-1 section 4.5.6
user @ home and @handle or @name2
room 12b floor 3 block c4
""".strip().splitlines()

TAGS = ("O", "B-tel", "I-tel", "B-ident", "I-ident", "B-mail", "I-mail", "B-name", "I-name", "B-addr", "I-addr")
MARKED = re.compile(r"\{([^|}]*)\|(\w+)\}")
HINT = re.compile(r"[\d@]")
WORD = re.compile(r"\S+")
NEVER = -1e4  # score of what can't be
LANE, WARM = 256, 32  # words of a stretch that is decoded beside others, and those before and behind that it starts from
WORDS_AT_ONCE, WORDS_KEPT = 100_000, 200_000  # of texts decoded together, at least; of a worker's cache
TRIM = ".,;:!?\"'<>[]{}|*#%&$="


def admissible() -> np.ndarray:
    """Scores of steps between tags: an inside follows only a begin or inside of its kind."""
    steps = np.zeros((len(TAGS), len(TAGS)))
    for i, j in itertools.product(range(len(TAGS)), repeat=2):
        if TAGS[j][0] == "I" and TAGS[i][2:] != TAGS[j][2:]:
            steps[i, j] = NEVER
    return steps


def shape(word: str) -> str:
    """Digits as 9, letters as a and A, runs of letters as one."""
    if word.isalpha() and word.islower():
        return "a"
    out = re.sub("\\d", "9", re.sub("[^\\W\\d_]", lambda m: "A" if m[0].isupper() else "a", word[:40]))
    return re.sub("a+", "a", re.sub("A+", "A", out))


def shape_features(own: str, digits: int, at: bool) -> list[str]:
    return ["bias", f"s={own}", f"n={digits}", f"l={len(own)}", f"p={own[:3]}", f"e={own[-3:]}", f"h={own.count('-')}", f"@={at}"]


def parts_of(word: str) -> tuple[str, int, bool]:
    """What the features of a word's shape are made from."""
    return shape(word), 0 if word.isalpha() else min(sum(c.isdigit() for c in word), 20), "@" in word


def own_features(word: str) -> list[str]:
    """Names of what is seen of the word alone."""
    return [*shape_features(*parts_of(word)), f"w={word.lower()}", f"x={word.lower()[-6:]}"]


def seen_before(word: str) -> tuple[str, str]:
    """How a word counts for those after it: as it is, and for the next one with digits as a shape."""
    plain = word.lower().strip(TRIM)
    return plain, shape(plain) if HINT.search(plain) else plain


def seen_after(word: str) -> str:
    return shape(word) if HINT.search(word) else word


def features(words: list[str], at: int) -> list[str]:
    """Names of what is seen at a word: its shape, its parts and its neighbours."""
    own = shape(words[at])
    before = [seen_before(words[at - i]) if at >= i else ("^", "^") for i in (1, 2, 3)]
    after = words[at + 1] if at + 1 < len(words) else "$"
    first, last = before[0][1], seen_after(after)
    return [
        *own_features(words[at]),
        f"b1={first}", f"b2={before[1][0]}", f"b3={before[2][0]}", f"a={last}", f"t={shape(after)}", f"s|b={own}|{first}", f"s|a={own}|{last}",
    ]


def labelled(line: str) -> tuple[list[str], list[int]]:
    words, tags, upto = [], [], 0
    for mark in [*MARKED.finditer(line), None]:
        plain = line[upto : mark.start() if mark else len(line)].split()
        words += plain
        tags += [0] * len(plain)
        if mark:
            inside = mark[1].split()
            words += inside
            tags += [TAGS.index(("B-" if i == 0 else "I-") + mark[2]) for i in range(len(inside))]
            upto = mark.end()
    return words, tags


class Field:
    """Weights of features and steps, fitted by gradient ascent on the likelihood."""

    def __init__(self, lines: list[str] = EXAMPLES, rounds: int = 150, rate: float = 0.3, ridge: float = 0.002):
        rows = [labelled(line) for line in lines]
        seen = [[features(words, i) for i in range(len(words))] for words, _ in rows]
        names = sorted({f for row in seen for found in row for f in found})
        self.index = {f: i for i, f in enumerate(names)}
        self.weights = np.zeros((len(names), len(TAGS)))
        self.allowed, self.steps = admissible(), np.zeros((len(TAGS), len(TAGS)))
        coded = [[np.array([self.index[f] for f in found]) for found in row] for row in seen]
        speed = [np.zeros_like(self.weights) + 1e-8, np.zeros_like(self.steps) + 1e-8]
        for _ in range(rounds):
            slopes = [-ridge * self.weights, -ridge * self.steps]
            for row, (_, tags) in zip(coded, rows):
                self.slope(row, tags, *slopes)
            for value, slope, size in zip((self.weights, self.steps), slopes, speed):
                size += slope**2
                value += rate * slope / np.sqrt(size)

    def slope(self, row: list[np.ndarray], tags: list[int], by_weight: np.ndarray, by_step: np.ndarray) -> None:
        """Add the gradient of one sequence: what is seen less what the model expects."""
        here = np.array([self.weights[f].sum(axis=0) for f in row])
        here[:, [t for t in range(len(TAGS)) if TAGS[t][0] == "I"]] += np.where(np.arange(len(row)) == 0, -1e4, 0)[:, None]
        steps = self.steps + self.allowed
        ahead, back = np.zeros_like(here), np.zeros_like(here)
        ahead[0] = here[0]
        for i in range(1, len(row)):
            ahead[i] = here[i] + np.logaddexp.reduce(ahead[i - 1][:, None] + steps, axis=0)
        for i in range(len(row) - 2, -1, -1):
            back[i] = np.logaddexp.reduce(steps + (here[i + 1] + back[i + 1])[None, :], axis=1)
        total = np.logaddexp.reduce(ahead[-1])
        for i, found in enumerate(row):
            miss = -np.exp(ahead[i] + back[i] - total)
            miss[tags[i]] += 1
            by_weight[found] += miss
            if i:
                by_step -= np.exp(ahead[i - 1][:, None] + steps + (here[i] + back[i])[None, :] - total)
                by_step[tags[i - 1], tags[i]] += 1

    def scores(self, words: list[str], at: int) -> np.ndarray:
        known = [self.index[f] for f in features(words, at) if f in self.index]
        return self.weights[known].sum(axis=0)

    def decode(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each row of words; plain words stand around them."""
        if not rows:
            return []
        plain = surely_plain(1)
        tags = best_path(np.concatenate([part for row in rows for part in (row, plain)]), self.steps + self.allowed)
        ends = np.cumsum([len(row) + 1 for row in rows]) - 1
        return [tags[end - len(row) : end] for row, end in zip(rows, ends)]


def surely_plain(n: int) -> np.ndarray:
    return np.where(np.arange(len(TAGS)) == 0, 0.0, NEVER) * np.ones((n, 1))


def step_on(best: np.ndarray, steps: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Scores of the best paths to each tag (tag x lane) one word on, the best of all at zero."""
    best = (best[:, None, :] + steps[:, :, None]).max(axis=0) + here
    return best - best.max(axis=0)


def best_path(here: np.ndarray, steps: np.ndarray, size: int = LANE, warm: int = WARM) -> np.ndarray:
    """Tags of the best path through all words (word x tag), from a plain word to a plain word.

    The words are cut into lanes that go on side by side.  A lane starts some words early from
    no knowledge; where it does not come to the same scores, or the same tag, as its neighbour
    has at their border, it is done again from there, so the path is that of the whole.
    """
    count, warm = len(here), min(size, warm)
    lanes = -(-count // size)
    rows = np.concatenate([surely_plain(warm), here, surely_plain(lanes * size - count)])
    best, ahead = np.zeros((len(TAGS), lanes)), np.empty((size, len(TAGS), lanes))
    for t in range(warm + size):
        best = step_on(best, steps, rows[t::size][:lanes].T)
        if t == warm - 1:
            begun = best
        if t >= warm:
            ahead[t - warm] = best
    floor = NEVER / 10  # what lies so far behind never wins
    for k in range(1, lanes):
        if not np.allclose(np.maximum(ahead[-1, :, k - 1], floor), np.maximum(begun[:, k], floor), rtol=0, atol=1e-9):
            best = ahead[-1, :, k - 1 : k]
            for t in range(size):
                best = step_on(best, steps, rows[warm + k * size + t][:, None])
                ahead[t, :, k] = best[:, 0]
    tags, into = np.zeros((size, lanes), dtype=np.int64), steps.T
    after = np.zeros(lanes, dtype=np.int64)
    after[:-1] = ahead[warm - 1, :, 1:].argmax(axis=0)
    for t in range(warm - 2, -1, -1):
        after[:-1] = (ahead[t, :, 1:].T + into[after[:-1]]).argmax(axis=1)
    guess = after
    for t in range(size - 1, -1, -1):
        after = (ahead[t].T + into[after]).argmax(axis=1)
        tags[t] = after
    for k in range(lanes - 2, -1, -1):
        if guess[k] != tags[0, k + 1]:
            tag = tags[0, k + 1]
            for t in range(size - 1, -1, -1):
                tag = tags[t, k] = (ahead[t, :, k] + into[tag]).argmax()
    return tags.T.reshape(-1)[:count]


class Words(dict):
    """Number of each word, with what it adds to the scores of itself and of its neighbours."""

    ROLES = ("b1", "b2", "b3", "a", "t")
    PLACES = (-1, -2, -3, 1, 1)

    def __init__(self, field: Field):
        super().__init__()
        self.field, none = field, np.zeros((1, len(TAGS)))
        self.weights = np.concatenate([none, field.weights])
        pairs = [(kind, *name.split("=", 1)[1].split("|", 1), i + 1) for name, i in field.index.items() for kind in ("s|b", "s|a") if name.startswith(kind + "=")]
        self.shapes = {own: n + 1 for n, own in enumerate(sorted({own for _, own, _, _ in pairs}))}
        self.near = {near: n + 1 for n, near in enumerate(sorted({near for _, _, near, _ in pairs}))}
        self.pairs = {kind: np.zeros((len(self.shapes) + 1, len(self.near) + 1), dtype=np.int32) for kind in ("s|b", "s|a")}
        for kind, own, near, i in pairs:
            self.pairs[kind][self.shapes[own], self.near[near]] = i
        self.by_role = {role: {n[len(role) + 1 :]: i for n, i in field.index.items() if n.startswith(role + "=")} for role in (*self.ROLES, "w", "x")}
        self.start()

    def start(self) -> None:
        """Forget all words; the first two are what stands before and behind a text."""
        self.clear()
        self.own, self.own_rows, self.codes = {}, [surely_plain(1)[0]], []
        self.by_shape: dict[tuple[str, int, bool], tuple[int, ...]] = {}
        at = lambda *names: [self.field.index.get(n, -1) + 1 for n in names]
        self.codes.append((0, *at("b1=^", "b2=^", "b3=^", "a=^", "t=^"), 0, self.near.get("^", 0), 0))
        self.codes.append((0, *at("b1=$", "b2=$", "b3=$", "a=$", "t=$"), 0, 0, self.near.get("$", 0)))

    def __missing__(self, raw: str) -> int:
        word, role = core(raw), self.by_role
        parts, low = parts_of(word), word.lower()
        known = self.by_shape.get(parts)
        if known is None:
            known = self.by_shape[parts] = tuple(self.field.index[f] for f in shape_features(*parts) if f in self.field.index)
        known = known, role["w"].get(low), role["x"].get(low[-6:])
        if known not in self.own:
            self.own[known] = len(self.own_rows)
            own = [*known[0], *(i for i in known[1:] if i is not None)]
            self.own_rows.append(self.field.weights[own].sum(axis=0))
        own, plain = parts[0], low.strip(TRIM)
        first, last = (plain, word) if word.isalpha() else (seen_before(word)[1], seen_after(word))
        number = self[raw] = len(self.codes)
        self.codes.append((
            self.own[known], role["b1"].get(first, -1) + 1, role["b2"].get(plain, -1) + 1, role["b3"].get(plain, -1) + 1,
            role["a"].get(last, -1) + 1, role["t"].get(own, -1) + 1,
            self.shapes.get(own, 0), self.near.get(first, 0), self.near.get(last, 0),
        ))
        return number

    def tags(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Best tags of all words of each text."""
        if len(self) > WORDS_KEPT:
            self.start()
        numbers, ends = [], []
        for words in texts:
            numbers += [0, 0, 0, *map(self.__getitem__, words), 1]
            ends.append(len(numbers) - 1)
        used, at = np.unique(np.array(numbers), return_inverse=True)
        codes = np.array([self.codes[n] for n in used], dtype=np.int32)[at]
        here = np.array(self.own_rows)[codes[:, 0]]
        inside = codes[:, 0] > 0

        def add(rows: np.ndarray) -> None:
            spots = np.flatnonzero((rows > 0) & inside)
            here[spots] += self.weights[rows[spots]]

        for column, place in enumerate(self.PLACES):
            add(np.roll(codes[:, column + 1], -place))
        add(self.pairs["s|b"][codes[:, 6], np.roll(codes[:, 7], 1)])
        add(self.pairs["s|a"][codes[:, 6], np.roll(codes[:, 8], -1)])
        tags = best_path(here, self.field.steps + self.field.allowed)
        return [tags[end - len(words) : end] for words, end in zip(texts, ends)]


def runs_of(text: str) -> list[tuple[list[str], int, list[tuple[int, int]]]]:
    """All words of a text as one run: words, place of the first, (start, end) of each."""
    spots = [m.span() for m in WORD.finditer(text)]
    return [([core(text[s:e]) for s, e in spots], 0, spots)] if spots else []


def core(word: str) -> str:
    return word.strip(TRIM) or word


def spans_of(text: str, group: list[tuple[int, int]], tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of a decoded run, without punctuation around them."""
    found: list[list] = []
    for (start, end), tag in zip(group, tags):
        name = TAGS[tag]
        word = text[start:end]
        start, end = start + len(word) - len(word.lstrip(TRIM)), end - (len(word) - len(word.rstrip(TRIM)))
        if name[0] == "B":
            found.append([name[2:], start, end])
        elif name[0] == "I":
            found[-1][2] = end
    return [(kind, start, end) for kind, start, end in found if start < end]


NUMBERS = itertools.count()  # of the fields in use, for the caches of workers


def portions(texts: list[str]) -> Iterator[list[int]]:
    """Places of the texts, so many at once that they have about ``WORDS_AT_ONCE`` words."""
    some, size = [], 0
    for i, text in enumerate(texts):
        some.append(i)
        size += len(text) // 6
        if size >= WORDS_AT_ONCE:
            yield some
            some, size = [], 0
    if some:
        yield some


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every whole text.

    Spans are kind:start:end in code points, base kinds first, then what the field adds
    where no base span lies (tel, ident, mail, name, addr).  A null or empty text has none; repeated
    rows and null ids stay; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(field or Field())
    out = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    kind, number = docs.schema[id_col].dataType.simpleString(), next(NUMBERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(("personal data", number), lambda: Words(model.value))
        for batch in batches:
            texts, rows, added = batch.column(1).to_pylist(), [], defaultdict(list)
            for some in portions(texts):
                for i, tags in zip(some, words.tags([texts[i].split() for i in some])):
                    if tags.any():
                        added[i] += spans_of(texts[i], [m.span() for m in WORD.finditer(texts[i])], tags)
            for i, text in enumerate(texts):
                base = base_spans(text)
                own = [f"{KINDS[k]}:{s}:{e}" for k, s, e in base]
                more = [f"{k}:{s}:{e}" for k, s, e in added[i] if all(e <= bs or be <= s for _, bs, be in base)]
                counts = [sum(k == n for k, _, _ in base) for n in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(",".join(own).encode()).hexdigest(), ",".join(own + more)))
            columns = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain.mapInArrow(run, f"doc_id {kind}, {out}")
