"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates are the matches of the format patterns. Those of the base kinds always stay; those of the other kinds are
proposals. On every candidate a format, a gazetteer and a context labeler vote for, against or abstain; the gazetteer knows
top-level domains, card issuers, the areas of social security numbers, the countries and lengths of IBANs and the national
numbering plan. Expectation-maximisation over the counts of vote patterns gives each labeler's reliability and each
pattern's probability; with these as soft labels a naive Bayes classifier over hashed features of the span, its
surroundings and its votes is trained from counts of the whole corpus, and it alone decides on the proposals.

Null and empty texts have no spans (counts 0, the digest of an empty string). Equal rows get equal results, an empty
table gives an empty result, other columns are not read. What reaches the driver is bounded by the number of kinds,
vote patterns and feature buckets.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import dropped, map_columns, saved

LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# possessive and anchored at runs of digits: the same matches in time linear in the text
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOCAL = re.compile(r"(?<![0-9+)] )(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])")
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "local_phone")
BASE = KINDS[:4]

# Common top-level domains, and words that tell what follows or what a number is not.
DOMAINS = set("com org net edu gov io de fr es eu uk us info biz co ch at it nl be ca au".split())
CONTEXT = {
    "email": r"e-?mail|mail|contact|write|address|adresse|correo|courriel",
    "ip": r"\bip\b|host|server|address|login|client",
    "card": r"card|visa|master|amex|credit|karte|carte|tarjeta|payment",
    "phone": r"phone|call|tel|mobile|fax|telefon|t.l.phone|tel.fono",
    "ssn": r"ssn|social security|sozialversicherung|s.curit. sociale|seguridad social",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "local_phone": r"phone|call|tel|mobile|fax|telefon|t.l.phone|tel.fono",
}
# Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
# Social security numbers that were printed as examples.
EXAMPLES = {"078-05-1120", "219-09-9999", "123-45-6789", "987-65-4320"}
CONTEXT = {k: re.compile(v, re.I) for k, v in CONTEXT.items()}
AGAINST = re.compile(r"isbn|version|order|invoice|serial|part no|build|rfc|sku", re.I)
BUCKETS = 1024
CANDIDATE = "struct<kind:int,start:int,end:int,votes:int,features:array<int>>"


#: Area code and exchange of the national numbering plan, neither of which ends in 11.
NUMBERING = re.compile(r"[2-9](?!11)[0-8][0-9][2-9](?!11)[0-9]{2}[0-9]{4}")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str):
    """(start, end) of local-part, at sign and domain: found from the at signs, so long words cost no more than once."""
    last = 0
    for m in DOMAIN.finditer(text):
        s = m.start()
        while s > last and text[s - 1] in LOCAL_PART:
            s -= 1
        if s < m.start():
            yield s, m.end()
            last = m.end()


def matches(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every candidate: the base kinds as defined, then proposals that touch none of them."""
    out = []
    if "@" in text:
        out += [(0, *span) for span in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    taken = sorted((s, e) for _, s, e in out)
    starts, reach = [s for s, _ in taken], [0, *accumulate((e for _, e in taken), max)]
    for kind, rx in ((4, SSN), (5, IBAN), (6, LOCAL)):
        for m in rx.finditer(text):
            if reach[bisect_left(starts, m.end())] <= m.start():  # no base span that begins before its end goes beyond its start
                out.append((kind, *m.span()))
    return out


def votes_of(text: str, kind: int, start: int, end: int) -> tuple[int, int, int]:
    """Votes of the format, gazetteer and context labelers: 2 for, 1 abstains, 0 against."""
    name, span = KINDS[kind], text[start:end]
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    edge = (start and (text[start - 1].isalnum() or text[start - 1] in "._-/")) or (after[:1].isalnum())
    if name == "ip":
        form = 0 if edge or any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else 2
    elif name == "iban":
        form = 2 if _iban(span) else 0
    elif name == "ssn":
        form = 0 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 2
    else:
        form = 1 if edge else 2
    if name == "email":
        listed = 2 if span.rpartition(".")[2].lower() in DOMAINS else 0
    elif name == "card":
        listed = 2 if span[0] in "3456" else 0
    elif name == "phone":
        listed = 0 if _digits(span)[:1] == "0" else 2
    elif name == "ip":
        listed = 0 if span.split(".")[0] in ("0", "255") else 1
    elif name == "ssn":  # areas that were given out before they were drawn at random
        area = int(span[:3])
        listed = 0 if span in EXAMPLES else 2 if 0 < area <= 733 and area != 666 or 750 <= area <= 772 else 1
    elif name == "iban":
        listed = 2 if IBAN_LENGTHS.get(span[:2]) == len(span.replace(" ", "")) else 0
    else:
        listed = 2 if NUMBERING.fullmatch(_digits(span)) else 0
    near = 0 if AGAINST.search(before) else 2 if CONTEXT[name].search(before) else 1
    return form, listed, near


def features_of(text: str, kind: int, start: int, end: int, votes: tuple[int, int, int]) -> list[int]:
    """Hashed features of the span itself, its surroundings and its votes, as buckets."""
    span = text[start:end]
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", span))))
    last = re.findall(r"\w+", text[max(0, start - 24) : start].lower())
    told = [f"shape:{shape[:24]}", f"len:{min(40, end - start)}", f"left:{text[start - 1 : start]}", f"right:{text[end : end + 1]}"]
    told.append(f"word:{last[-1] if last else ''}")
    told += [f"vote:{i}:{v}" for i, v in enumerate(votes)]
    return sorted({int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=4).digest(), "little") % BUCKETS for t in told})


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its candidates, their votes (base 3) and features."""

    def run(ids, texts):
        out = []
        for t in texts:
            found = matches(t) if t else []
            row = []
            for kind, s, e in found:
                a, b, c = votes_of(t, kind, s, e)
                row.append({"kind": kind, "start": s, "end": e, "votes": 9 * a + 3 * b + c, "features": features_of(t, kind, s, e, (a, b, c))})
            out.append(row)
        return [ids, out]

    plain = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return map_columns(plain, run, f"doc_id long, found array<{CANDIDATE}>")


def reliabilities(counts: dict[int, int], rounds: int = 50) -> tuple[dict[int, float], np.ndarray, float]:
    """EM over vote patterns of one kind: P(true) of each pattern, P(vote | truth) of each labeler, and the prior.

    It starts from majority votes; a tenth of a count on either side keeps probabilities off 0 and 1.
    """
    codes = np.array(sorted(counts))
    n = np.array([counts[c] for c in codes], float)
    votes = np.stack([codes // 9, codes // 3 % 3, codes % 3])
    p = np.clip(0.5 + 0.3 * (votes - 1).sum(axis=0), 0.05, 0.95)
    for _ in range(rounds):
        prior = float(np.clip((n * p).sum() / n.sum(), 0.02, 0.98))
        rel = np.array([[[0.1 + (n * w * (v == x)).sum() for x in range(3)] for w in (1 - p, p)] for v in votes])
        # a labeler is better than chance: what votes for is likelier where the span is true
        rel /= rel.sum(axis=2, keepdims=True)
        no, yes = (math.log(q) + sum(np.log(rel[i, y][votes[i]]) for i in range(3)) for y, q in ((0, 1 - prior), (1, prior)))
        p = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
    return dict(zip(codes.tolist(), p.tolist(), strict=True)), rel, prior


def fit(found: DataFrame) -> tuple[dict[int, dict[int, float]], dict[int, float], dict[tuple[int, int], float]]:
    """Pattern probabilities by kind; then the classifier's prior log-odds and weight of each feature bucket."""
    each = found.select(F.explode("found").alias("c")).select("c.*")
    counts: dict[int, dict[int, int]] = {}
    for r in each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect():  # kinds x 27 at most
        counts.setdefault(r["kind"], {})[r["votes"]] = r["n"]
    soft = {k: reliabilities(c)[0] for k, c in counts.items()}
    prior, weight = {}, {}
    for k, c in counts.items():
        yes = sum(n * soft[k][v] for v, n in c.items())
        no = sum(c.values()) - yes
        prior[k] = math.log((yes + 0.5) / (no + 0.5))
    per = each.select("kind", "votes", F.explode("features").alias("f")).groupBy("kind", "f", "votes").agg(F.count("*").alias("n"))
    sums: dict[tuple[int, int], list[float]] = {}
    for r in per.toLocalIterator():  # kinds x BUCKETS x 27 at most
        s, p = sums.setdefault((r["kind"], r["f"]), [0.0, 0.0]), soft[r["kind"]][r["votes"]]
        s[0] += r["n"] * (1 - p)
        s[1] += r["n"] * p
    totals = {k: (sum(n * (1 - soft[k][v]) for v, n in c.items()), sum(n * soft[k][v] for v, n in c.items())) for k, c in counts.items()}
    for (k, f), (no, yes) in sums.items():
        weight[k, f] = math.log((yes + 0.5) / (totals[k][1] + 1)) - math.log((no + 0.5) / (totals[k][0] + 1))
    return soft, prior, weight


def decide(found: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>): the base spans, and proposals that the classifier accepts."""
    _, prior, weight = fit(found)

    def run(ids, found):
        out = []
        for row in found:
            keep = []
            for c in row or []:
                k = c["kind"]
                odds = prior[k] + sum(weight.get((k, f), 0.0) for f in c["features"])
                if k < len(BASE) or odds > 0:
                    keep.append({"kind": k, "start": c["start"], "end": c["end"]})
            out.append(sorted(keep, key=lambda x: (x["kind"], x["start"])))
        return [ids, out]

    return map_columns(found, run, "doc_id long, spans array<struct<kind:int,start:int,end:int>>")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its spans. The texts are read once; candidates go through a table in the shared folder."""
    return decide(saved(candidates(docs, id_col, text_col)))


def digest(spans: DataFrame) -> DataFrame:
    def run(ids, rows):
        out = []
        for doc, row in zip(ids, rows, strict=True):
            told = [(s["kind"], f"{KINDS[s['kind']]}:{s['start']}:{s['end']}") for s in row]
            counts = [sum(k == i for k, _ in told) for i in range(len(BASE))]
            out.append((doc, *counts, _sha(",".join(t for k, t in told if k < len(BASE))), ",".join(t for _, t in told)))
        return list(zip(*out, strict=True)) or [[]] * 7

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_columns(spans.select("doc_id", "spans"), run, schema)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets; all columns stay.

    Spans ride along with the rows they were found in, so no join and no unique id is needed: the fitted model is
    applied to candidates found again in the same pass.
    """
    found = saved(candidates(docs, id_col, text_col))
    _, prior, weight = fit(found)
    dropped(found)
    columns = docs.columns
    at = columns.index(text_col)
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)

    def run(*cols):
        texts = []
        for t in cols[at]:
            if t:
                keep = []
                for k, s, e in matches(t):
                    if k >= len(BASE):
                        features = features_of(t, k, s, e, votes_of(t, k, s, e))
                        if prior[k] + sum(weight.get((k, f), 0.0) for f in features) <= 0:
                            continue
                    keep.append((s, -e, k))
                out, last = [], 0
                for s, e, k in sorted(keep):
                    if -e > last:  # of overlapping spans the first and longest names the place, all are covered
                        out += [t[last:s], f"<{KINDS[k]}>"] if s >= last else []
                        last = max(last, -e)
                t = "".join(out) + t[last:]
            texts.append(t)
        return [*cols[:at], texts, *cols[at + 1 :]]

    return map_columns(docs, run, schema)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    return digest(find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")))
