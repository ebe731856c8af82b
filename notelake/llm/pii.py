"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the certain spans. What they miss (a phone number that runs into another number, the same number written in another way
later in the text, an address with a broken host) is decided by a conditional random field over each document's candidate
tokens, those that hold a digit or an ``@``, and the spans that patterns found. All other tokens are clamped to the label O, so leaving them
out of the graph changes no marginal. Neighbouring candidates share a chain potential; distant tokens that are equal
or similar (same last digits, same four numbers, same e-mail name) share a skip potential, linked occurrence to next occurrence,
so the graph has at most two edges a token. Token weights and both potentials are learnt from a small table of labelled documents
by pseudo-likelihood. Loopy sum-product message passing, in sweeps forward and backward until
no message changes, gives the marginals; spans that patterns found enter as evidence and pull their distant repetitions with them.

Null and empty texts give no spans, an empty table gives an empty table. A text is judged whole, by itself, and no column but the text
is read, so repeated rows and clashing column names make no difference. Time grows with the length of a text, whatever is in it. Of
labels with equal marginals none is accepted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.shared import table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)

EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_NAME = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: A run of digits is only entered at its start: from further inside it can match nothing that its start does not.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
SPACE = re.compile(r"\s")
EDGE_CHARS = ".,:;()[]\"'|!#*$%&<>"
DIGITS = re.compile(r"[0-9]")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches found from their ``@``: the name is the whole run of name characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in NAME_CHARS:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every pattern match that holds, by start, then kind."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 9 <= len(DIGITS.findall(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# The random field ------------------------------------------------------------------------------------

FEATURES = (
    "bias", "has_at", "name_at_host", "at_and_dot", "three_dots", "four_numbers", "digits_1_5", "digits_6_8", "digits_9_11", "digits_12_19", "digits_20",
    "letters", "all_digits", "plus", "brackets", "hyphens", "after_phone_word", "after_card_word", "after_mail_word", "after_host_word",
)
#: Words before a token that hint at what it is; fixed lists, English, German, French and Spanish.
HINTS = {
    "after_phone_word": ("phone", "tel", "call", "telefon", "téléphone", "teléfono", "mobile", "fax"),
    "after_card_word": ("card", "visa", "karte", "carte", "tarjeta", "mastercard"),
    "after_mail_word": ("mail", "email", "e-mail", "contact", "kontakt", "correo"),
    "after_host_word": ("ip", "host", "server", "address", "adresse"),
}
#: The labelled table: short documents, personal data in braces with its kind. What patterns find by themselves is labelled, too.
LABELLED = (
    "please call {phone:+49 (30) 123-4567} or write to {email:ann.lee@site.example.org} before 2024 ends",
    "my number {phone:+1 (202) 555-0143} {ip:10.20.30.40} was logged with 4736 others on page 17",
    "logged {phone:+1 (416) 555-2291} {ip:172.16.254.3} and {phone:+1 (713) 555-8810} {ip:8.8.4.4} twice in 1999.",
    "thn {phone:+1 (909) 555-6121} {card:4111111111111111} then order 20240517 of 12.50",
    "und {phone:+1 (334) 555-9042} 98079157 dann {phone:+1 (205) 555-1187} 30040050060 weiter",
    "la {phone:+1 (650) 555-7350} 2024 de {phone:+1 (312) 555-6644} {ip:192.168.7.1} et 10,000 gens",
    "call {phone:+33142685300} today, again {phone:33142685300} tomorrow and {phone:0142685300} at night in room b12",
    "tel {phone:+1-202-555-0199} later as {phone:(202)555-0199} or {phone:12025550199} with code 12345678",
    "fax {phone:+4930123456789} is also {phone:030123456789} but 030 alone is not, nor 2024-05-17",
    "my phone {phone:0897654321} rings, so again {phone:0897654321} or room 0123",
    "call {phone:312-555-4478} now or {phone:646-555-9034} at 10:30, order 555-12",
    "tel {phone:0611223344} then fax {phone:040-3344556} and part 30-40-50",
    "number 0301112223 is an order and 415-555-8899 a part, count 0897654322 too",
    "phone {phone:+12125550100} and then {phone:212-555-0100} from 3rd street 42",
    "card {card:4012888888881881} given twice: {card:4012.8888.8888.1881} and order 99887766554433",
    "visa {card:5500005555555559} and {card:5500_0055_5555_5559} were typed by user 7 at 12:30",
    "pay {card:30569309025904} then {card:3056/930902/5904} on 12/05/2023 for 1,200.00",
    "mail {email:bob_7@mail.example.com} bounced, {email:bob_7@mailexample} too, see @home and a@b",
    "from {email:x.y+z@a-b.example} to {email:x.y+z@localhost} about section 4.5",
    "by {email:kim.22@host.example.net} or {email:kim.22@host} at 8.30 with @user in copy",
    "host {ip:192.168.7.14} also as {ip:192-168-7-14} runs version 1.2.3 since 2019",
    "server {ip:203.0.113.77} was {ip:203_0_113_77} in file 17 of 22",
    "node {ip:172.116.254.133} then {ip:172-116-254-133} while 120-130-140-150 is a measure of 2020",
    "number 9807915762804490 is an order, 9807915762804490 again, and nr 4000123412341234 as well",
    "serial 778899001122 and 778899001122 on the box, sum 123456789012345678901234 in all",
    "token = deadbeef0123456789 key a1b2c3d4 hash b44e15e09fd311c3cf3163b66d5a9875b883d8ce done",
    "see version 3. or 4.0. of the licence, section 2.0, costs 3.14 or 12.50 and 10,000",
    "count 000111222333444 then 1234567890123456 and 5927243074273351!! and 9000426309966109$$$ here",
    "the @ sign, is a@b right? see @user and @home on 5551234 or 2024",
    "id 99887766554433 and id 99887766554433 but year 1999. page 17 line 4",
    "items 12, 15 and 18 of 2023 at 7 pm in room b12, 3rd floor, 42 people",
    "isbn 9783161484100 then 978-3-16-148410-0 and part 20240517 again 20240517",
    "ratio 0.5 of 1.5 is 33% at 10:15, see 2001.12.31 or 31.12.2001 for more",
    "release 10.4.1 build 20593301 rev 4455667788 rev 4455667788 ok",
    "1 2 3 4 5 6 7 8 and 10 11 12 then 20 30 40 in rows",
)
MARKED = re.compile(r"\{(\w+):([^}]*)\}")
ROUNDS, RATE, DECAY = 800, 0.4, 0.0004
#: Added to the score of a pattern's own label at its span.
EVIDENCE = 10.0
ACCEPT = 0.6
#: Messages stand still below this change. A field that still moves after FREE_SWEEPS is damped more with every sweep, so that it ends.
TOLERANCE, FREE_SWEEPS, COOLING = 1e-4, 100, 0.9
CHAIN, SKIP = 0, 1


def features(before: str, token: str) -> np.ndarray:
    n, low = len(DIGITS.findall(token)), before.lower().strip(".,:;()\"'")
    core = token.strip(EDGE_CHARS)
    on = {
        "bias": 1, "has_at": "@" in token, "name_at_host": bool(re.fullmatch(r"[\w.%+-]{3,}@[\w-]{3,}", core)), "at_and_dot": bool(re.fullmatch(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+", core)),
        "three_dots": bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", core)), "four_numbers": bool(re.fullmatch(r"[0-9]{1,3}([^0-9A-Za-z][0-9]{1,3}){3}", core)), "digits_1_5": 1 <= n <= 5, "digits_6_8": 6 <= n <= 8,
        "digits_9_11": 9 <= n <= 11, "digits_12_19": 12 <= n <= 19, "digits_20": n >= 20, "letters": any(c.isalpha() for c in token),
        "all_digits": core.isdigit(), "plus": token.startswith("+"), "brackets": "(" in token, "hyphens": "-" in token,
    } | {name: low in words for name, words in HINTS.items()}
    return np.array([float(on[f]) for f in FEATURES])


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs without white space that hold a digit or an @; every character is passed once or twice, however long a run is."""
    done, m = 0, MARK.search(text)
    while m:
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        stop = SPACE.search(text, m.end())
        done = stop.start() if stop else len(text)
        yield start, done
        m = MARK.search(text, done)


def alike(token: str) -> str:
    """What two similar tokens have in common: the name of an e-mail, four small numbers, or the last seven digits."""
    if "@" in token:
        name = token.split("@")[0].lower().strip(EDGE_CHARS)
        return f"{name}@" if len(name) > 2 else ""
    numbers = re.findall("[0-9]+", token)
    if len(numbers) == 4 and all(len(x) < 4 for x in numbers):
        return ".".join(numbers)
    digits = "".join(DIGITS.findall(token))
    return digits[-7:] if len(digits) >= 7 else ""


Node = tuple[int, int, int | None]


def field(text: str, base: list[tuple[int, int, int]]) -> tuple[list[Node], list[tuple[int, int, int]]]:
    """Nodes (start, end, kind of a base span or None) and edges (earlier, later, CHAIN or SKIP). A base span is one node, whatever its tokens."""
    nodes: list[Node] = [(a, b, kind) for a, kind, b in base]
    k = 0
    for start, end in candidates(text):
        while k < len(base) and base[k][2] <= start:
            k += 1
        j = k
        while j < len(base) and base[j][0] < end and base[j][2] <= start:
            j += 1
        if j == len(base) or base[j][0] >= end:
            nodes.append((start, end, None))
    nodes.sort(key=lambda x: x[:2])
    last: dict[str, int] = {}
    edges = []
    for i, (start, end, _) in enumerate(nodes):
        if i and 0 <= start - nodes[i - 1][1] <= 1:
            edges.append((i - 1, i, CHAIN))
        if common := alike(text[start:end]):
            if common in last:
                edges.append((last[common], i, SKIP))
            last[common] = i
    return nodes, edges


def node_features(text: str, nodes: list[Node]) -> np.ndarray:
    rows = []
    for start, end, _ in nodes:
        head = text[max(0, start - 40) : start].split()
        rows.append(features(head[-1] if head else "", text[start:end]))
    return np.array(rows).reshape(-1, len(FEATURES))


def labelled_fields(documents=LABELLED) -> list[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """(features, labels, edges) of each labelled document."""
    out = []
    for marked in documents:
        text, spans, at = "", [], 0
        for m in MARKED.finditer(marked):
            text += marked[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), LABELS.index(m[1])))
            text, at = text + m[2], m.end()
        text += marked[at:]
        nodes, edges = field(text, base_spans(text))
        y = np.array([next((k for a, b, k in spans if a < end and start < b), 0) for start, end, _ in nodes])
        out.append((node_features(text, nodes), y, edges))
    return out


def learnt(documents=LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Token weights and the two potentials (logarithms, label by label) that maximise the regularised pseudo-likelihood of labelled documents.

    Each node's label is predicted from its token and the true labels of its neighbours; gradient ascent, equal on every worker.
    """
    n = len(LABELS)
    xs, ys, a, b, kinds, first = [], [], [], [], [], 0
    for x, y, edges in labelled_fields(documents):
        xs.append(x)
        ys.append(y)
        a += [first + i for i, _, _ in edges]
        b += [first + j for _, j, _ in edges]
        kinds += [k for *_, k in edges]
        first += len(y)
    x, y = np.concatenate(xs), np.eye(n)[np.concatenate(ys)]
    a, b, kinds = np.array(a), np.array(b), np.array(kinds)
    #: around[k][i]: how many neighbours of each label node i has over edges of kind k.
    around = np.zeros((2, len(y), n))
    for k in (CHAIN, SKIP):
        np.add.at(around[k], a[kinds == k], y[b[kinds == k]])
        np.add.at(around[k], b[kinds == k], y[a[kinds == k]])
    w, pair = np.zeros((x.shape[1], n)), np.zeros((2, n, n))
    for _ in range(ROUNDS):
        score = x @ w + around[0] @ pair[0] + around[1] @ pair[1]
        p = np.exp(score - score.max(1, keepdims=True))
        miss = y - p / p.sum(1, keepdims=True)
        w += RATE * (x.T @ miss / len(y) * n - DECAY * w)
        for k in (CHAIN, SKIP):
            step = around[k].T @ miss / len(y) * n
            pair[k] += RATE * ((step + step.T) / 2 - DECAY * pair[k])
    return w, pair


@lru_cache(1)
def weights() -> tuple[np.ndarray, np.ndarray]:
    return learnt()


def marginals(unary: np.ndarray, edges: list[tuple[int, int, int]], potentials: np.ndarray) -> np.ndarray:
    """Loopy sum-product: every edge (from an earlier to a later node) carries the potential of its kind, by the labels at both ends.

    A sweep sends messages from the first node to the last and back, so one sweep reaches a chain's end, whatever its length.
    """
    into = unary.astype(float).copy()
    later: list[list[int]] = [[] for _ in unary]
    earlier: list[list[int]] = [[] for _ in unary]
    for e, (a, b, _) in enumerate(edges):
        later[a].append(e)
        earlier[b].append(e)
    weight = np.exp(potentials)
    forward, backward = np.zeros((len(edges), unary.shape[1])), np.zeros((len(edges), unary.shape[1]))

    def send(e: int, source: int, target: int, message: np.ndarray, answer: np.ndarray) -> float:
        sent = into[source] - answer[e]
        new = np.log(np.exp(sent - sent.max()) @ weight[edges[e][2]])
        change = step * (new - new.max() - message[e])
        message[e] += change
        into[target] += change
        return float(np.abs(change).max())

    moved, sweep, step = math.inf if edges else 0.0, 0, 1.0
    while moved > TOLERANCE:
        moved = 0.0
        for i in range(len(unary)):
            for e in later[i]:
                moved = max(moved, send(e, i, edges[e][1], forward, backward))
        for i in range(len(unary) - 1, -1, -1):
            for e in earlier[i]:
                moved = max(moved, send(e, i, edges[e][0], backward, forward))
        sweep += 1
        step = COOLING ** max(0, sweep - FREE_SWEEPS)
    p = np.exp(into - into.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def crf_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the random field adds; none overlaps a base span. Neighbouring tokens of one kind are one span."""
    nodes, edges = field(text, base)
    if len(nodes) == len(base):
        return []
    w, pair = weights()
    unary = node_features(text, nodes) @ w
    for i, (*_, kind) in enumerate(nodes):
        if kind is not None:
            unary[i, 1 + kind] += EVIDENCE
    p = marginals(unary, edges, pair)
    chained = {b for _, b, k in edges if k == CHAIN}
    found: list[tuple[int, int, int]] = []
    joins = False
    for i, (start, end, kind) in enumerate(nodes):
        label, token = int(p[i].argmax()), text[start:end]
        core = token.strip(EDGE_CHARS)
        if not label or kind is not None or p[i, label] < ACCEPT or not core:
            joins = False
            continue
        if joins and i in chained and found[-1][1] == label - 1:
            found[-1] = (found[-1][0], label - 1, end - len(token) + len(token.rstrip(EDGE_CHARS)))
        else:
            found.append((start + len(token) - len(token.lstrip(EDGE_CHARS)), label - 1, end - len(token) + len(token.rstrip(EDGE_CHARS))))
        joins = True
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = "base array<struct<kind:string,start:int,end:int>>, added array<struct<kind:string,start:int,end:int>>"


def spans_found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    said = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
    for texts in batches:
        rows = []
        for text in texts:
            base = base_spans(text or "")
            rows.append((said(base), said(crf_spans(text or "", base))))
        yield pd.DataFrame(rows, columns=["base", "added"])


def personal_data(text: Column) -> Column:
    """A struct of the spans that patterns found (base) and those that the random field added."""
    return F.pandas_udf(spans_found, FOUND)(text)


def find_personal_data(docs: DataFrame, text: str = "text", out: str = "personal_data") -> DataFrame:
    """docs and a struct column ``out`` (a column of that name is replaced)."""
    return docs.withColumn(out, personal_data(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every found span replaced by its kind in brackets."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            pieces, at = [], 0
            base = base_spans(t or "")
            for a, k, b in sorted(base + crf_spans(t or "", base)):
                if b > at:
                    pieces += [t[at : max(a, at)], f"[{KINDS[k]}]" if a >= at else ""]
                    at = b
            out.append(t if t is None else "".join(pieces) + t[at:])
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, cut(F.col(text)))


def span_text(spans: Column) -> Column:
    """kind:start:end, by start, then kind as listed, joined by commas."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.col("personal_data.base")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.concat(base, F.col("personal_data.added"))).alias("spans"),
    )
