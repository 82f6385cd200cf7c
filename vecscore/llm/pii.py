"""Personal data by weak supervision, with DataFrame functions only.

Base spans come from one strict pattern for each kind and its test (parts up to 255, Luhn, digit counts).
Looser patterns find further candidates: spelled-out e-mail addresses, bracketed IP addresses, cards in runs of digits, phones
without a country code, access keys. On every candidate labelers vote for (1), against (-1) or not (0):
the strict pattern, a gazetteer (top-level domains, address blocks, card issuers, area codes), the words before, the
characters around, and the form. Expectation-maximisation on the counts of patterns, over all
texts, estimates each labeler's reliability by kind and so every vote pattern's probability. The final classifier
is a logistic model for each kind, on the votes and on features of the span and its context that no labeler sees, trained on those
probabilities; as a Column expression it decides on the candidates, and those it accepts are added where no base span overlaps them.

What reaches the driver are pattern counts: 5 kinds by 3**5 votes by 2**5 features at most.

Time is linear. Texts of over `PART` characters are cut behind characters that no pattern has, or before a space between
letters, which no pattern crosses, so matches are found and compared within parts of bounded size, and context comes with a part. (A part
ends at the first such place after PART characters. A very long stretch without any, of digits and blanks for instance, stays one part; there
positions are added up in groups of about the root of its matches, so its time grows with power 1.5.)
Positions are code points, end exclusive. A match's place is the sum of the pieces and matches before it
(`split` and `regexp_extract_all` of one pattern), so both find the same matches. Patterns use possessive
repeats and start at a run's first character (or where the last match ended), which changes no match and
keeps time linear and the regex engine's stack flat on very long texts.

Null and empty texts have no spans. An empty table gives an empty table. Rows are treated one by one: repeated rows and ids, null ids and columns of any
name change nothing (only the id and the text are read). Candidates of several kinds in one place are all decided on.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests without which a pattern can't match.
GUARD = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,63}){1,8}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)| dot )[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "key": r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])",
}
LOOSE_GUARD = {"email": r"@|\(at\)|\[at\]", "ip": r"[0-9](?:\.|\[\.\]|\(\.\)| dot )[0-9]", "card": r"[0-9]{4}[\x20-]?[0-9]{4}", "phone": r"[0-9]{3}\)?[\x20.-][0-9]{3}", "key": r"[0-9a-f]{32}"}
#: Gazetteers, fixed values: top-level domains; first digits of card issuers.
TOP_LEVEL = (
    "com org net edu gov mil int info biz name pro io ai app dev cloud online shop site tech xyz me tv cc co "
    "at au be br ca ch cn cz de dk es eu fi fr gr hu ie il in it jp kr lu mx nl no nz pl pt ro ru se sg sk tr tw ua uk us za"
).split()
ISSUERS = "4 51 52 53 54 55 22 23 24 25 26 27 34 37 36 38 6011 644 645 646 647 648 649 65 62 35".split()
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|schreib|correo|courriel)\W*$",
    "ip": r"(?i)(?:ip|addr|address|host|server|client|from|peer|adresse|direcci.n)\W*$",
    "card": r"(?i)(?:card|visa|master|karte|carte|tarjeta|pay)\W*$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|ruf|appel|llam)\W*$",
    "key": r"(?i)(?:token|secret|key|password|passwd|bearer)\W*$",
}
LABELERS = ("strict", "gazetteer", "context", "around", "form")
FEATURES = ("long", "blanks", "starts", "labelled", "ends")
LONG = {"email": 24, "ip": 13, "card": 16, "phone": 12, "key": 39}
BEFORE = 24
PART = 4096
_BOUND = r"(?<=[^A-Za-z0-9._%+@()\[\]\x20-])|(?<=[A-Za-z])(?=\x20[A-Za-z])|\z"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m have a valid check digit."""
    d = F.transform(F.split(F.reverse(digits(m)), ""), lambda x: F.coalesce(F.try_to_number(x, F.lit("9")).cast("int"), F.lit(0)))
    twice = F.transform(d, lambda x, i: F.when(i % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10 == 0


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": lambda m: F.when(F.length(digits(m)).between(16, 19), luhn(m)).otherwise(False),
    "phone": lambda m: F.length(digits(m)).between(8, 15),
    "key": lambda m: F.lit(True),
}


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x made once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _grouped(n: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """Rows of kind (which has s and e) that step appends to a["out"] for 0 to n - 1, a["at"] being the length so far; in groups of
    about the root of n, so that appending copies little."""
    g = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    groups = F.transform(F.sequence(F.lit(0), n - 1, g), lambda i: F.aggregate(F.sequence(i, F.least(i + g, n) - 1), zero, step))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,out:array<{kind}>>>").alias("out"))
    placed = F.aggregate(groups, start, lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.array_append(a["out"], F.struct(a["at"].alias("at"), x["out"].alias("out"))).alias("out")))["out"]
    move = lambda x, by: x.withField("s", x["s"] + by).withField("e", x["e"] + by)
    return F.flatten(F.transform(placed, lambda q: F.transform(q["out"], lambda x: move(x, q["at"]))))


Make = Callable[[Column, Column, Column, Column, Column], Column]


def find_spans(part: Column, pattern: str, guard: str, keep: Callable[[Column], Column], kind: str = "struct<s:int,e:int>", make: Make | None = None, prev: Column | None = None, following: Column | None = None) -> Column:
    """array<kind> of the pattern's leftmost matches that are kept, in code points; make(m, s, e, before, after) gives more than s and e.
    prev and following are the text around the part."""
    prev, following = (F.lit("") if x is None else x for x in (prev, following))

    def spans(b: Column) -> Column:
        piece, found = (lambda i: F.get(b["p"], i)), (lambda i: F.get(b["m"], i))

        def step(a: Column, i: Column) -> Column:
            s = a["at"] + F.length(piece(i))
            e = s + F.length(found(i))
            if make is None:
                row = F.struct(s.alias("s"), e.alias("e"))
            else:
                before = F.right(F.concat(F.coalesce(piece(i - 1), prev), F.coalesce(found(i - 1), F.lit("")), piece(i)), F.lit(BEFORE))
                after = F.substring(F.concat(piece(i + 1), F.coalesce(found(i + 1), following)), 1, 1)
                row = make(found(i), s, e, before, after)
            kept = found(i).isNotNull() & F.coalesce(keep(found(i)), F.lit(False))
            return F.struct(F.coalesce(e, s).alias("at"), F.when(kept, F.array_append(a["out"], row)).otherwise(a["out"]).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return _grouped(F.size(b["p"]), zero, step, kind)

    both = F.struct(F.split(part, pattern, -1).alias("p"), F.regexp_extract_all(part, F.lit(pattern), F.lit(0)).alias("m"))
    return F.when(part.rlike(guard), let(both, spans)).otherwise(F.array().cast(f"array<{kind}>"))


def parts(text: Column, size: int = PART) -> Column:
    """array<struct<off, prev, part, following>>: the text in parts of at least `size` characters (but the last), cut where no pattern crosses."""
    cut = F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s).{{{size}}}.*?(?:{_BOUND})|.+"), F.lit(0)))

    def place(ps: Column) -> Column:
        kind = "struct<s:int,e:int,prev:string,part:string,following:string>"

        def step(a: Column, i: Column) -> Column:
            here = F.get(ps, i)
            row = F.struct(a["at"].alias("s"), (a["at"] + F.length(here)).alias("e"), F.coalesce(F.right(F.get(ps, i - 1), F.lit(BEFORE)), F.lit("")).alias("prev"), here.alias("part"),
                           F.coalesce(F.substring(F.get(ps, i + 1), 1, 1), F.lit("")).alias("following"))
            return F.struct((a["at"] + F.length(here)).alias("at"), F.array_append(a["out"], row).alias("out"))

        return _grouped(F.size(ps), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), step, kind)

    return let(cut, place)


_CANDIDATE = "struct<kind:string,s:int,e:int,votes:array<int>>"


def candidates(x: Column) -> Column:
    """array<struct<kind, s, e, votes>> of the loose patterns' matches in a part; votes are followed by features."""
    out = []
    for kind, pattern in LOOSE.items():
        make = lambda m, s, e, before, after, kind=kind: F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), votes(kind, m, before, after).alias("votes"))
        out.append(find_spans(x["part"], pattern, LOOSE_GUARD[kind], lambda m: m.isNotNull(), _CANDIDATE, make, x["prev"], x["following"]))
    return F.concat(*out)


def votes(kind: str, m: Column, before: Column, after: Column) -> Column:
    """array<int>: one for each of LABELERS, then one (0 or 1) for each of FEATURES."""
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    never = F.lit(False)
    strict = vote(m.rlike(f"^(?:{STRICT[kind]})$") & VALID[kind](m), never) if kind in STRICT else F.lit(0)
    octets = F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    domain = F.lower(F.regexp_extract(m, "[A-Za-z0-9-]+$", 0)).isin(*TOP_LEVEL)
    area = F.substring(digits(m), 1, 3)
    gazetteer = {
        "email": vote(domain, ~domain),
        "ip": vote(F.get(octets, F.lit(0)).between(1, 223), ~F.get(octets, F.lit(0)).between(1, 223)),
        "card": vote(digits(m).rlike(f"^(?:{'|'.join(ISSUERS)})"), ~digits(m).rlike(f"^(?:{'|'.join(ISSUERS)})")),
        "phone": vote(area.rlike("^[2-9][0-8][0-9]$") & ~area.rlike("11$"), area.rlike("^[01]|^.9|11$")),
        "key": F.lit(0),
    }[kind]
    context = vote(before.rlike(CONTEXT[kind]), before.rlike(r"(?i)(?:no\.?|nr\.?|id|isbn|#|version|v)\s*$"))
    around = vote((before.rlike(r"(?:^|[\s\"'(<:=,;|])$") | (F.length(before) == 0)) & ((after == "") | after.rlike(r"[\s\"'.,;:!?)>|*#$%&]")), before.rlike(r"[\p{L}\p{N}]$") | after.rlike(r"[\p{L}\p{N}]"))
    form = {
        "email": vote(m.rlike("@|[(\\[]at"), never),
        "ip": vote(F.forall(octets, lambda o: o <= 255) & ~m.rlike("(?<![0-9])0[0-9]"), F.exists(octets, lambda o: o > 255)),
        "card": vote(luhn(m), ~luhn(m)),
        "phone": vote(m.rlike(r"^\("), ~m.rlike(r"^\(?[0-9]{3}\)?([\x20.-])[0-9]{3}\1[0-9]{4}$")),
        "key": vote(m.rlike("[0-9]") & m.rlike("[a-f]"), ~(m.rlike("[0-9]") & m.rlike("[a-f]"))),
    }[kind]
    features = (F.length(m) > LONG[kind], m.rlike(r"[\x20-]"), (F.length(before) == 0) | before.rlike(r"\n$"), before.rlike(r"[:=]\s*$"), (after == "") | after.rlike(r"\s"))
    return F.array(strict, gazetteer, context, around, form, *(f.cast("int") for f in features)).cast("array<int>")


def _merged(counts: dict[tuple, int], width: int) -> dict[tuple, int]:
    out: dict[tuple, int] = {}
    for k, n in counts.items():
        out[k[:width]] = out.get(k[:width], 0) + n
    return out


def estimate(counts: dict[tuple, int], rounds: int = 50) -> dict[tuple, float]:
    """P(personal | kind, votes) by expectation-maximisation. counts: (kind, *votes, *features) to number of candidates.

    A vote's probabilities given each class are estimated for each kind and labeler, with a prior that a
    vote is right three times in four; the start is the majority of the votes."""
    width = 1 + len(LABELERS)
    whole, counts = counts, _merged(counts, width)
    p = {k: 1 / (1 + math.exp(-sum(k[1:]))) for k in counts}
    for _ in range(rounds):
        new = {}
        for kind in sorted({k[0] for k in counts}):
            own = {k: n for k, n in counts.items() if k[0] == kind}
            total = sum(own.values())
            yes = sum(n * p[k] for k, n in own.items())
            prior = (yes + 1) / (total + 2)
            rate = []
            for j in range(1, len(LABELERS) + 1):
                tally = {True: {1: 3.0, 0: 2.0, -1: 1.0}, False: {1: 1.0, 0: 2.0, -1: 3.0}}
                for k, n in own.items():
                    tally[True][k[j]] += n * p[k]
                    tally[False][k[j]] += n * (1 - p[k])
                rate.append({c: {v: x / sum(t.values()) for v, x in t.items()} for c, t in tally.items()})
            for k in own:
                z = math.log(prior / (1 - prior)) + sum(math.log(r[True][v] / r[False][v]) for r, v in zip(rate, k[1:], strict=True))
                new[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        p = new
    return {k: p[k[:width]] for k in whole}


def _active(k: tuple) -> list[int]:
    """Numbers of the inputs that are 1: bias, votes for, votes against, features."""
    n = len(LABELERS)
    return [0, *(1 + j for j, v in enumerate(k[1 : 1 + n]) if v == 1), *(1 + n + j for j, v in enumerate(k[1 : 1 + n]) if v == -1), *(1 + 2 * n + j for j, v in enumerate(k[1 + n :]) if v)]


def train(counts: dict[tuple, int], rounds: int = 300, rate: float = 1.0, decay: float = 1e-3) -> dict[str, list[float]]:
    """Weights of each kind's logistic span classifier, fitted to the estimated probabilities by gradient steps."""
    p, out = estimate(counts), {}
    for kind in LOOSE:
        own = {k: n for k, n in sorted(counts.items()) if k[0] == kind}
        w, total = [0.0] * (1 + 2 * len(LABELERS) + len(FEATURES)), max(1, sum(own.values()))
        rows = [(_active(k), n / total, p[k]) for k, n in own.items()]
        for _ in range(rounds if rows else 0):
            g = [decay * x for x in w]
            for x, n, y in rows:
                err = n * (1 / (1 + math.exp(-sum(w[j] for j in x))) - y)
                for j in x:
                    g[j] += err
            w = [a - rate * b for a, b in zip(w, g, strict=True)]
        out[kind] = w
    return out


def accepted(c: Column, w: dict[str, list[float]]) -> Column:
    n, out = len(LABELERS), F.lit(False)
    for kind, own in w.items():
        z = F.lit(own[0])
        for j in range(n):
            z = z + F.when(c["votes"][j] == 1, own[1 + j]).when(c["votes"][j] == -1, own[1 + n + j]).otherwise(0.0)
        for j in range(len(FEATURES)):
            z = z + F.when(c["votes"][n + j] == 1, own[1 + 2 * n + j]).otherwise(0.0)
        out = F.when(c["kind"] == kind, z > 0).otherwise(out)
    return out


def _free(loose: Column, base: Column) -> Column:
    """The loose spans that no base span overlaps; base spans are looked at in groups with their bounds."""

    def with_groups(groups: Column) -> Column:
        meets = lambda c, g: (g["s"] < c["e"]) & (g["e"] > c["s"])
        return F.filter(loose, lambda c: ~F.exists(groups, lambda g: meets(c, g) & F.exists(g["of"], lambda b: meets(c, b))))

    def group(of: Column) -> Column:
        return F.struct(F.array_min(F.transform(of, lambda b: b["s"])).alias("s"), F.array_max(F.transform(of, lambda b: b["e"])).alias("e"), of.alias("of"))

    def grouped(b: Column) -> Column:
        g = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(b))).cast("int"))
        return let(F.transform(F.sequence(F.lit(1), F.size(b), g), lambda i: group(F.slice(b, i, g))), with_groups)

    return F.when((F.size(loose) == 0) | (F.size(base) == 0), loose).otherwise(let(base, grouped))


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: int = PART) -> DataFrame:
    """One row for each of docs: doc_id, base (spans of KINDS with kind, s, e, by kind as listed and start) and added (those of the method, by kind and start)."""
    src = docs.select(F.col(doc_id).alias("id"), parts(F.coalesce(F.col(text), F.lit("")), part).alias("ps"))
    votes_of = src.select(F.explode(F.flatten(F.transform("ps", candidates))).alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n"))
    w = train({(r[0], *r[1]): r[2] for r in votes_of.collect()})
    move = lambda spans, by: F.transform(spans, lambda x: x.withField("s", x["s"] + by).withField("e", x["e"] + by))

    def own(x: Column) -> Column:
        base = [find_spans(x["part"], STRICT[k], GUARD[k], VALID[k]).alias(k) for k in KINDS]
        return F.struct(x["s"].alias("off"), *base, F.filter(candidates(x), lambda c: accepted(c, w)).alias("loose"))

    def settled(x: Column) -> Column:
        free = F.transform(_free(x["loose"], F.concat(*(x[k] for k in KINDS))), lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
        return F.struct(*(move(x[k], x["off"]).alias(k) for k in KINDS), move(free, x["off"]).alias("added"))

    found = src.select("id", F.transform("ps", own).alias("found")).select("id", F.transform("found", settled).alias("found"))
    of = lambda k: F.flatten(F.transform("found", lambda x: x[k]))
    named = lambda kind: F.transform(of(kind), lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return found.select(F.col("id").alias(doc_id), F.concat(*map(named, KINDS)).alias("base"), F.array_sort(of("added")).alias("added"))


def span_list(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
