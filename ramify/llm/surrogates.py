"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

Detected: e-mail addresses, phone, card, bank-account (IBAN) and social-security numbers, IPv4 addresses, secrets
(assigned tokens, long hexadecimal strings), and names behind a form of address.

An entity has a normal form (digits of a number, address in lower case), and its surrogate is a keyed permutation of
that form within its shape: digit for digit, letter for letter of the same script, valid octets for an address, a given
name of the same gender and script for a given name. It is poured back into the layout of the place (separators,
capitals), so every mention of one entity, however written, gets one surrogate (coreference).

Collision check: over all documents the distinct entities and their surrogates are compared. Where two entities have
one surrogate, or a surrogate equals an entity that occurs, all but one (all, in the second case) are drawn anew with
the next attempt number, until none is left. Entities that needed a later attempt are few; they are joined to their
documents, by broadcast only up to `BROADCAST_ROWS` of them.

Defined cases: a null text stays null; empty texts and texts without entities stay as they are, byte for byte. Overlapping
finds: the first begins first, then the longest. Repeated rows and ids are replaced alike. An empty table gives no rows.
A space of fewer forms than entities cannot hold distinct surrogates; the last attempt is then kept and the pair reported
by `collisions`.
"""

import hashlib
import ipaddress
import re

import pyarrow as pa
from pyspark.sql import functions as F

from ramify.llm.common import cut, drop_cut, map_texts

BROADCAST_ROWS = 20_000
ATTEMPTS = 12
HANDLED = "kind string, norm string"

# Forms of address by gender, and common given names by gender and script.
TITLES = {"m": "Mr Herr Monsieur Señor Sr Don Sir Господин".split(),
          "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Doña Madam Госпожа".split()}
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Richard Joseph Thomas Charles Hans Peter Klaus Jürgen Pierre "
                    "Jean Michel Luis Carlos José Juan Antonio Paul Mark".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Ursula Monika Petra "
                    "Marie Claire Sophie Carmen María Lucía Elena Julia Laura Emma".split(),
    ("m", "cyrillic"): "Александр Сергей Дмитрий Андрей Алексей Иван Михаил Николай Владимир Павел".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Юлия Екатерина".split(),
}
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß", "αβγδεζηθικλμνξοπρστυφχψω",
             "абвгдежзийклмнопрстуфхцчшщъыьэюя"]
_TITLE = {t: g for g, ts in TITLES.items() for t in ts}
_NAME = {n: k for k, ns in GIVEN.items() for n in ns}
_ALPHA = {c: a for a in ALPHABETS for c in a}

_PATTERN = re.compile(r"""
  (?P<email>[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,})
 |(?P<secret>(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd)\b\s*[:=]\s*)["']?(?P<value>[^\s"']{6,})
   |(?<![\w])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,}(?![\w]))
 |(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
 |(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))
 |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
 |(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)
   |(?<![\w(])\(\d{3}\)[ ]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))
 |(?P<card>(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w]))
""", re.X)
_NAMED = re.compile(r"""(?P<name>(?<!\w)(?P<title>%s)\.?\s+(?P<full>[^\W\d_]+(?:\s+[^\W\d_a-zß-öø-ÿа-я][^\W\d_]*)?))
""" % "|".join(sorted(_TITLE, key=len, reverse=True)), re.X)
_CHEAP = re.compile(r"[@\d]")


# ---- detection --------------------------------------------------------------

def find(text):
    """Entities of a text: (start, end, kind, normal form). The kind carries what a surrogate must match."""
    out = []
    if not text:
        return out
    if any(t in text for t in _TITLE):
        for m in _NAMED.finditer(text):
            if m["full"][0].isupper():
                out.append((*m.span("full"), f"name-{_TITLE[m['title']]}", " ".join(m["full"].split())))
    for m in _PATTERN.finditer(text) if _CHEAP.search(text) else ():  # all other kinds hold a digit or @
        if m["email"]:
            out.append((m.start(), m.end(), "email", m["email"].lower()))
        elif m["secret"]:
            a, b = m.span("value") if m["value"] else m.span("secret")
            value = text[a:b].rstrip(".,;:!?")
            if not m["value"] or any(c.isdigit() for c in value):
                hexa = re.fullmatch(r"[0-9a-fA-F]+", value)
                out.append((a, a + len(value), "hex" if hexa else "secret", value.lower() if hexa else value))
        else:
            kind = next(k for k in ("iban", "ip", "ssn", "phone", "card") if m[k])
            raw = m[kind]
            if kind == "ip":
                norm = str(ipaddress.IPv4Address(".".join(str(int(x)) for x in raw.split("."))))
            else:
                norm = re.sub(r"[^0-9A-Z]", "", raw)
                if kind == "phone":
                    norm = ("+" if raw.startswith("+") else "") + norm
                    if not 8 <= len(norm.lstrip("+")) <= 15:
                        continue
                if kind == "phone" and raw.startswith("+"):
                    kind += f"-{len(re.match(r'[+](\d{1,3})', raw)[1])}"  # the country code stays
            out.append((m.start(), m.end(), kind, norm))
    out.sort(key=lambda e: (e[0], -e[1]))
    kept, end = [], 0
    for e in out:
        if e[0] >= end:
            kept.append(e)
            end = e[1]
    return kept


# ---- keyed permutations -----------------------------------------------------

def permute(value, size, key, tweak):
    """Keyed permutation of 0 .. size - 1: a Feistel network, walked until it falls inside."""
    if size <= 1:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for r in range(8):
            d = hashlib.blake2b(right.to_bytes(width, "big") + bytes([r]) + tweak, key=key, digest_size=min(64, width + 4))
            left, right = right, left ^ (int.from_bytes(d.digest(), "big") & mask)
        value = left << half | right
        if value < size:
            return value


def permute_text(text, key, tweak):
    """Text of the same shape: every letter in its alphabet and case, every digit a digit, other signs unchanged."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    sets = [("0123456789" if c in "0123456789" else _ALPHA.get(c)) for c in low]
    value, size = 0, 1
    for c, s in zip(low, sets, strict=True):
        if s:
            value, size = value * len(s) + s.index(c), size * len(s)
    # the shape belongs to the tweak: texts of different shape keep different results
    value = permute(value, size, key, tweak)
    out = []
    for c, s, was in zip(reversed(low), reversed(sets), reversed(text), strict=True):
        if s:
            value, at = divmod(value, len(s))
            c = s[at]
            if was.isupper() and len(c.upper()) == 1:
                c = c.upper()
        else:
            c = was
        out.append(c)
    return "".join(reversed(out))


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def surrogate(kind, norm, key, attempt=0):
    """Surrogate of a normal form; a permutation of the forms of one kind and shape for every attempt."""
    tweak = f"{kind}/{attempt}".encode()
    if kind == "ip":
        at = int(ipaddress.IPv4Address(norm))
        private = ipaddress.IPv4Address(at).is_global
        while True:  # an address of the same scope
            at = permute(at, 1 << 32, key, tweak)
            if ipaddress.IPv4Address(at).is_global == private:
                return str(ipaddress.IPv4Address(at))
    if kind == "card":
        valid, out = _luhn(norm), norm
        while True:  # a number whose check digit is right exactly if it was
            out = permute_text(out, key, tweak)
            if _luhn(out) == valid:
                return out
    if kind.startswith("phone"):
        code = 1 + int(kind[6:]) if kind[5:] else 0
        return norm[:code] + permute_text(norm[code:], key, tweak)
    if kind == "iban":
        return norm[:2] + permute_text(norm[2:], key, tweak)
    if kind == "hex":
        return f"{permute(int(norm, 16), 16 ** len(norm), key, tweak):0{len(norm)}x}"
    if kind == "email":
        local, _, domain = norm.partition("@")
        host, _, top = domain.rpartition(".")
        both = permute_text(local + "@" + host, key, tweak)
        return f"{both}.{top}"
    if kind.startswith("name"):
        given, *rest = norm.split(" ")
        group = _NAME.get(given)
        if group and group[0] == kind[-1]:
            names = GIVEN[group]
            new = names[permute(names.index(given), len(names), key, tweak + " ".join(rest).encode())]
        else:
            new = permute_text(given, key, tweak)
        return " ".join([new, *(permute_text(r, key, tweak) for r in rest)])
    return permute_text(norm, key, tweak)


def pour(new, kind, place):
    """The surrogate in the layout of the place it replaces."""
    if kind == "ip" or kind.startswith("name"):
        return new
    if kind == "hex":
        return new.upper() if place == place.upper() else new
    if kind == "email":
        return "".join(n.upper() if p.isupper() and len(n.upper()) == 1 else n for n, p in zip(new, place, strict=True))
    signs = iter(new.lstrip("+"))
    if kind == "secret":
        return new
    return "".join(next(signs) if c.isascii() and c.isalnum() else c for c in place)


def rewrite(text, key, attempts):
    """The text with surrogates, and the places (start, end, kind) in the new text. `attempts`: (kind, norm) to attempt."""
    out, places, at, size = [], [], 0, 0
    for a, b, kind, norm in find(text):
        new = pour(surrogate(kind, norm, key, attempts.get((kind, norm), 0)), kind, text[a:b])
        out += [text[at:a], new]
        size += a - at
        places.append({"start": size, "end": size + len(new), "kind": kind.split("-")[0]})
        size += len(new)
        at = b
    return ("".join([*out, text[at:]]) if places else text), places


# ---- jobs -------------------------------------------------------------------

def entities(df, text="text"):
    """Distinct (kind, norm) over all documents."""
    def part(batch):
        found = {(k, n) for t in batch.column(0).to_pylist() for _, _, k, n in find(t)}
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([n for _, n in found], pa.string())],
                                          names=["kind", "norm"])
    return map_texts(df.select(df[text].alias("t")), part, HANDLED).distinct()


def _drawn(table, key):
    """table (kind, norm, attempt) with its surrogates."""
    def part(batch):
        kinds, norms, tries = (c.to_pylist() for c in batch.columns)
        new = [surrogate(k, n, key, a) for k, n, a in zip(kinds, norms, tries, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "norm", "attempt", "new"])
    return map_texts(table, part, HANDLED + ", attempt int, new string")


def draw(found, key, attempts=ATTEMPTS):
    """Every entity with an attempt number and surrogate, after the collision checks: (kind, norm, attempt, new)."""
    real = found.select(F.col("kind").alias("rk"), F.col("norm").alias("rn"))
    drawn = cut(_drawn(found.select("kind", "norm", F.lit(0).alias("attempt")), key))
    for last in range(1, attempts):
        taken = drawn.groupBy("kind", "new").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("attempt", "norm")).alias("first"))
        twice = taken.filter("c > 1").select("kind", "new", F.col("first.norm").alias("stays"))
        same = drawn.join(twice, ["kind", "new"]).filter("norm <> stays").select("kind", "norm")
        exists = drawn.join(real, (F.col("kind") == F.col("rk")) & (F.col("new") == F.col("rn")), "left_semi").select("kind", "norm")
        again = cut(same.union(exists).distinct())
        if again.isEmpty():
            drop_cut(again)
            break
        redone = _drawn(again.select("kind", "norm", F.lit(last).alias("attempt")), key)
        drawn = cut(drawn.join(again, ["kind", "norm"], "left_anti").union(redone), retire=drawn)
        drop_cut(again)
    return drawn


def collisions(drawn):
    """Surrogates that stand for more than one entity; empty unless a shape has fewer forms than entities."""
    return drawn.groupBy("kind", "new").count().filter("count > 1")


def replace(df, key, text="text", doc_id="doc_id"):
    """df's ids with the rewritten `text`, its `n_entities` and `entities` (start, end, kind in the new text)."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = cut(entities(rows))
    later = cut(draw(found, key).filter("attempt > 0").select("kind", "norm", "attempt"))
    few = later.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, text string, n_entities int, entities array<struct<start:int,end:int,kind:string>>"
    place = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])

    def written(batch, known):
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        done = [rewrite(t, key, known(i)) if t else (t, []) for i, t in enumerate(texts)]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([t for t, _ in done], pa.string()), pa.array([len(p) for _, p in done], pa.int32()),
             pa.array([p for _, p in done], pa.list_(place))], names=["doc_id", "text", "n_entities", "entities"])

    if few:
        table = {(r["kind"], r["norm"]): r["attempt"] for r in later.collect()}
        shared = df.sparkSession.sparkContext.broadcast(table)  # at most BROADCAST_ROWS rows
        return map_texts(rows, lambda batch: written(batch, lambda i: shared.value), schema)

    def occurrences(batch):
        marks, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        seen = {(h, k, n) for h, t in zip(marks, texts, strict=True) for _, _, k, n in find(t)}
        h, k, n = zip(*seen, strict=True) if seen else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(k, pa.string()), pa.array(n, pa.string())],
                                          names=["mark", "kind", "norm"])

    marked = rows.withColumn("mark", F.xxhash64("text"))
    where = map_texts(marked.select("mark", "text"), occurrences, "mark long, " + HANDLED).distinct()
    per_text = where.join(later, ["kind", "norm"]).groupBy("mark").agg(
        F.collect_list(F.struct("kind", "norm", "attempt")).alias("known"))  # at most the entities of one text
    joined = marked.join(per_text, "mark", "left").select("doc_id", "text", "known")

    def with_known(batch):
        lists = batch.column(2).to_pylist()
        return written(batch, lambda i: {(x["kind"], x["norm"]): x["attempt"] for x in lists[i] or ()})

    return map_texts(joined, with_known, schema)
