"""Replacement of personal data by keyed surrogates of the same type, script and format (column functions only).

Surrogates are values of keyed bijections, so that one entity has one surrogate in every document
(coreference), and two entities of a type never share one (distinctness) without a table of
entities, a shuffle or a second look. The bijections:

* letters, digits and hex digits: each character moves within its own class by an amount taken from
  a keyed hash of the type, the entity's shape (which surrogates share) and the original characters
  before it. Reading from the left, every step can be undone, so the map is one to one; the first
  character that can move always does, and every letter and number of any script can, so none maps to
  itself. Length, case, script and punctuation stay, and so do calling codes and top-level domains.
* card numbers (only numbers with a right check digit are cards): the digits before the check digit
  move, and the check digit is the right one for them.
* IPv4 addresses: octets move within the private, loopback and link-local ranges and within the first
  octets of public ones; IPv6 ones move by hex digits.
* person names: listed names rotate by a keyed amount in their list of one gender and script; other
  words of a name move by letters. A name that stands alone in a text with the full one is
  replaced as in the full one.

The amounts are taken from SHA-256 over a subkey of each type and the hashed values; subkeys are
HMAC-SHA-256 values of a secret key that has to be given. They reach the rows through a
one-row table, so that they do not stand as literals in plans.

``collisions`` checks on the data that no two entities of a type share a surrogate.
"""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from collections import defaultdict
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._text import spare_name

#: first names by gender and script, and family names by script; fixed values
NAMES = {
    "given_f": "Alice Anna Clara Emma Eva Helen Isabel Julia Laura Lena Maria Nora Olivia Paula Sarah Sofia".split(),
    "given_m": "Adam Albert David Eric Felix Henry James John Lucas Mark Martin Oscar Paul Peter Robert Thomas".split(),
    "given_f_cyrl": "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    "given_m_cyrl": "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
    "family": "Anderson Baker Brown Clark Davis Evans Fischer Garcia Harris Jackson Johnson Jones Keller Lopez Martinez Miller Moore Moreau Schmidt Smith Taylor Walker Weber Williams Wilson".split(),
    "family_cyrl": "Васильев Иванов Кузнецов Морозов Новиков Петров Попов Смирнов Соколов Фёдоров".split(),
}
#: patterns in order of precedence, as alternatives of one expression; fixed values
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,256}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}"
SECRET = r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|(?<![0-9A-Za-z])(?=[0-9a-f]{0,39}[a-f])(?=[0-9a-f]{0,39}[0-9])[0-9a-f]{32,64}(?![0-9A-Za-z]))"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)"
CARD = r"(?<![\d])(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IPV6 = r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{0,38}[0-9A-Fa-f])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,38}[0-9])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z:])"
#: international numbers of 7 to 15 digits, in one piece or up to seven groups; national ones from 0, of 8 or more, but no dates; three groups
PHONE = r"(?:(?<![\d+])\+(?=(?:[ .()/-]{0,2}\d){7})(?!(?:[ .()/-]{0,2}\d){16})(?:\d{7,15}|\d{1,3}(?:[ .()/-]{1,2}\d{1,8}){1,6})(?!\d)|(?<![\d+.,/-])(?!\d{1,2}[./-]\d{1,2}[./-](?:\d{4}|\d{2})(?![./-]?\d))\(?(?=0\d(?:[ .()/-]{0,2}\d){6})0\d{1,4}\)?(?:[ ./-]\d{2,8}){1,5}(?!\d)|(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d))"
#: forms of address, which stay, and capitalised words that are no family names; fixed values
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Mme Mlle Señor Señora Sr Sra".split()
NO_NAMES = "A After And As At Before But By For From Had Has He Her His I If In Is It Of On Or She That The They This To Was We When Who Will With You".split()
#: calling codes (none begins another), which stay; fixed values
CALLING = "^[+](?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: kinds of entities with a key of their own
KINDS = ("email", "secret", "hex", "iban", "ip", "ip6", "card", "ssn", "phone", "given", "family", "name")
_DIGIT_OR_AT = "[0-9@]|:[A-Fa-f]{1,4}:"
_WORD = r"\p{Lu}[\p{L}'’-]{1,40}"


class Patterns:
    """The expressions of entities, with persons by lists of names: given_<gender>[_<script>] and family[_<script>]."""

    def __init__(self, names: dict[str, list[str]]):
        of = lambda kind: [n for k, v in names.items() if k.startswith(kind) for n in v]
        for n in of("given") + of("family"):
            if not n.replace("-", "").replace("'", "").isalpha():
                raise ValueError(f"not a name: {n}")
        if len(set(of(""))) < len(of("")):  # two names alone, of two lists, could get one surrogate
            raise ValueError("a name stands twice in the lists")
        given, family = "|".join(of("given")), "|".join(of("family"))
        other = rf"(?!(?:{'|'.join(NO_NAMES)})(?!\p{{L}})){_WORD}"
        title = rf"(?:{'|'.join(TITLES)})\.? {other}(?: {other})?"
        starts = "".join(sorted({n[0] for n in of("given")} | {t[0] for t in TITLES}))
        self.names = names
        self.person = rf"(?<!\p{{L}})(?=[{starts}])(?:(?:{given}) (?:{family}|{other})|{title})(?!\p{{L}})"
        self.types = (("email", EMAIL), ("secret", SECRET), ("iban", IBAN), ("ip", IPV4), ("ip6", IPV6), ("card", CARD), ("ssn", SSN), ("phone", PHONE), ("person", self.person))
        self.entity = "|".join(f"({p})" for _, p in self.types)
        # a text without a digit, an at sign and the start of a person has no entity, and is only scanned for these
        tails = "|".join([n[1:] for n in of("given")] + [t[1:] + r"\.?" for t in TITLES])
        self.start = rf"(?<!\p{{L}})[{starts}](?:{tails}) \p{{Lu}}"


@cache
def _default_patterns() -> Patterns:
    return Patterns(NAMES)


#: ranges of characters that move among themselves: first, last; fixed values. The first three are all of ASCII
CLASSES = (("0", "9"), ("a", "z"), ("A", "Z"), ("à", "ö"), ("À", "Ö"), ("α", "ρ"), ("Α", "Ρ"), ("а", "я"), ("А", "Я"), ("一", "鿿"))
#: a range of at least so many characters is moved by code points, without a listed alphabet
LARGE = 256


@cache
def _alphabets() -> tuple[tuple[str, str, str], ...]:
    """(first, last, characters) of the classes of letters and numbers outside ASCII; no characters for large ranges.

    What CLASSES leaves is classed by script and category, in large ranges one by one; a character alone
    in its class joins those of its script, or else the others that are left.
    """
    out, groups = [], defaultdict(list)
    for a, b in CLASSES[3:]:
        every = "".join(chr(x) for x in range(ord(a), ord(b) + 1))
        out.append((a, b, every if len(every) < LARGE else ""))
    for x in range(0x80, 0x110000):
        kind = unicodedata.category(chr(x))
        if kind[0] in "LN" and not any(a <= chr(x) <= b for a, b, _ in out):
            groups[unicodedata.name(chr(x), "-").replace("-", " ").split(" ")[0], kind].append(x)
    for level in (1, 0):
        for k in [k for k, v in groups.items() if len(v) == 1]:
            groups[k[0] if level else "", k[1][0]] += groups.pop(k)  # letters and numbers apart
    for v in groups.values():
        runs = [[x] for x in v[:1]]
        for x in sorted(v)[1:]:
            if x == runs[-1][-1] + 1:
                runs[-1].append(x)
            else:
                runs.append([x])
        out += [(chr(r[0]), chr(r[-1]), "") for r in runs if len(r) >= LARGE]
        rest = "".join(chr(x) for r in runs if len(r) < LARGE for x in r)
        if rest:
            out.append((rest[0], rest[-1], rest))
    return tuple(out)


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _type_of(m: str, patterns: Patterns | None = None) -> str:
    """SQL: the type of what the entity expression or a known single name matched; NULL for a card number with a wrong check digit."""
    types = (patterns or _default_patterns()).types
    whole = " ".join(f"WHEN {m} RLIKE {_q('^(?:' + p + ')$')} THEN " + (f"if({_is_luhn(m)}, 'card', NULL)" if t == "card" else f"'{t}'") for t, p in types)
    return f"CASE {whole} ELSE 'person' END"


def _is_luhn(m: str) -> str:
    return f"luhn_check(regexp_replace({m}, '[^0-9]', ''))"


def _amount(n: str, key: str, *values: str) -> str:
    """SQL: a keyed number from 0 to n - 1."""
    return f"pmod(cast(conv(substr(sha2(concat_ws('\u001f', {key}, {', '.join(values)}), 256), 1, 15), 16, 10) AS bigint), {n})"


def _moved(m: str, classes: str, key: str, keep: str = "''", far: bool = False) -> str:
    """SQL: the characters of ``m`` moved within their classes; those before the prefix ``keep`` stay.

    The state holds the original prefix p, the output o, and whether a character has moved.
    """
    shape = f"regexp_replace(translate({m}, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'aaaaaaaaaaaaaaaaaaaaaaaaaaAAAAAAAAAAAAAAAAAAAAAAAAAA0000000000'), '[^\\\\x00-\\\\x7F]', 'é')"
    width = f"filter({classes}, k -> c BETWEEN k.a AND k.b AND (k.all = '' OR instr(k.all, c) > 0))"
    by = lambda n: f"if(s.moved, {_amount(n, key, shape, 's.p')}, 1 + {_amount(f'({n} - 1)', key, shape, 's.p')})"
    listed = f"substr(k.all, 1 + int(pmod(instr(k.all, c) - 1 + {by('length(k.all)')}, length(k.all))), 1)"
    size = "(ascii(k.b) - ascii(k.a) + 1)"  # ascii() is the code point
    ranged = f"decode(unhex(lpad(hex(ascii(k.a) + pmod(ascii(c) - ascii(k.a) + {by(size)}, {size})), 8, '0')), 'UTF-32')"
    other = f"if(k.all = '', {ranged}, {listed})" if far else listed
    # one() binds a value in SQL, as lambdas have no let
    step = f"""try_element_at(transform(array(try_element_at({width}, 1)), k ->
        if(k IS NULL OR length(s.p) < length({keep}),
          named_struct('p', concat(s.p, c), 'o', concat(s.o, c), 'moved', s.moved),
          named_struct('p', concat(s.p, c),
            'o', concat(s.o, {other}),
            'moved', true))), 1)"""
    return f"aggregate(filter(split({m}, ''), c -> c <> ''), named_struct('p', '', 'o', '', 'moved', false), (s, c) -> {step}, s -> s.o)"


def _classes(hexadecimal: bool = False, digits_only: bool = False, far: bool = False) -> str:
    """SQL: the classes as an array; with ``far``, those for the character c, of ASCII or of all else."""
    if hexadecimal:
        return "array(named_struct('a', '0', 'b', 'f', 'all', '0123456789abcdef'), named_struct('a', 'A', 'b', 'F', 'all', 'ABCDEF'))"
    row = lambda a, b, every: f"named_struct('a', '{a}', 'b', '{b}', 'all', '{every}')"
    sql = lambda rows: f"array({', '.join(row(*x) for x in rows)})"
    near = sql([(a, b, "".join(chr(x) for x in range(ord(a), ord(b) + 1))) for a, b in CLASSES[: 1 if digits_only else 3]])
    return f"if(ascii(c) < 128, {near}, {sql(_alphabets())})" if far else near


def _luhn(d: str) -> str:
    """SQL: the check digit for a string of digits."""
    return f"""pmod(10 - pmod(aggregate(sequence(1, length({d})), 0, (n, i) -> n + if(pmod(length({d}) - i, 2) = 0,
        if(2 * int(substr({d}, i, 1)) > 9, 2 * int(substr({d}, i, 1)) - 9, 2 * int(substr({d}, i, 1))), int(substr({d}, i, 1)))), 10), 10)"""


def _ip(m: str, k: str) -> str:
    """SQL: private, loopback and link-local addresses stay such, and public ones public; the first octets of mixed ranges stay."""
    octet = lambda i: f"int(split({m}, '[.]')[{i}])"
    before = lambda i: f"substring_index({m}, '.', {i})"
    free = lambda i: f"pmod({octet(i)} + {_amount('256', k, before(i))}, 256)"
    moved = lambda i: f"pmod({octet(i)} + 1 + {_amount('255', k, before(i))}, 256)"
    by = lambda allowed, p: _amount(f"(size({allowed}) - 1)", k, p)
    within = lambda allowed, i, p: f"try_element_at({allowed}, int(1 + pmod(array_position({allowed}, {octet(i)}) + {by(allowed, p)}, size({allowed}))))"
    public = "array_except(sequence(1, 223), array(10, 100, 127, 169, 172, 192, 198, 203))"
    second = lambda gone: within(f"array_except(sequence(0, 255), {gone})", 1, before(1))
    join = lambda *o: f"concat_ws('.', {', '.join(f'string({x})' for x in o)})"
    return f"""CASE WHEN {octet(0)} IN (0, 10, 100, 127, 198, 203) OR {octet(0)} > 223 THEN {join(octet(0), moved(1), free(2), free(3))}
        WHEN {m} RLIKE '^(192[.]168|169[.]254)[.]' THEN {join(octet(0), octet(1), moved(2), free(3))}
        WHEN {octet(0)} = 172 AND {octet(1)} BETWEEN 16 AND 31 THEN {join('172', within('sequence(16, 31)', 1, before(1)), free(2), free(3))}
        WHEN {octet(0)} = 172 THEN {join('172', second('sequence(16, 31)'), free(2), free(3))}
        WHEN {octet(0)} = 192 THEN {join('192', second('array(168)'), free(2), free(3))}
        WHEN {octet(0)} = 169 THEN {join('169', second('array(254)'), free(2), free(3))}
        ELSE {join(within(public, 0, "''"), free(1), free(2), free(3))} END"""


def _person(m: str, patterns: Patterns, keys: str, family_here: str) -> str:
    """SQL: the words of a name one by one: forms of address stay, listed names rotate, others move by letters.

    The last word of several counts as a family name first, others as given names; a name alone
    as what ``family_here``, the family names of the text's full names, says.
    """
    lists = lambda kind: "array(" + ", ".join("array(" + ", ".join(_q(n) for n in v) + ")" for g, v in patterns.names.items() if g.startswith(kind)) + ")"

    def turn(w, kind):
        by = _amount("(size(l) - 1)", f"{keys}.{kind}", "l[0]")
        return f"try_element_at(transform(filter({lists(kind)}, l -> size(l) > 1 AND array_contains(l, {w})), l -> try_element_at(l, int(1 + pmod(array_position(l, {w}) + {by}, size(l))))), 1)"

    other = _moved("w", _classes(far=True), f"{keys}.name", far=True)
    last = f"(i > 0 AND i = size(split({m}, ' ')) - 1) OR (size(split({m}, ' ')) = 1 AND array_contains({family_here}, w))"
    given, family = turn("w", "given"), turn("w", "family")
    word = f"CASE WHEN w RLIKE '^({'|'.join(TITLES)})[.]?$' THEN w WHEN {last} THEN coalesce({family}, {given}, {other}) ELSE coalesce({given}, {family}, {other}) END"
    return f"array_join(transform(split({m}, ' '), (w, i) -> {word}), ' ')"


def surrogate_sql(m: str, keys: str = "_keys", family_here: str = "_family", patterns: Patterns | None = None) -> str:
    """SQL for the surrogate of the entity in the SQL value ``m``, by its type."""
    patterns = patterns or _default_patterns()
    key = lambda kind: f"{keys}.{kind}"
    digits = "regexp_replace(n, '[^0-9]', '')"
    moved = _moved("b", _classes(digits_only=True), key("card"))
    check = f"string(try_element_at(transform(array({digits}), d -> {_luhn('d')}), 1))"
    card = f"try_element_at(transform(array(substr({m}, 1, length({m}) - 1)), b -> try_element_at(transform(array({moved}), n -> concat(n, {check})), 1)), 1)"
    phone = _moved(m, _classes(digits_only=True), key("phone"), f"regexp_extract({m}, '{CALLING}', 0)")
    prefix = f"regexp_extract({m}, '^(?:AKIA|gh[pousr]_|sk-)', 0)"
    secret = f"if({m} RLIKE '^[0-9a-f]+$', {_moved(m, _classes(hexadecimal=True), key('hex'))}, {_moved(m, _classes(), key('secret'), prefix)})"
    local = f"regexp_extract({m}, '^(.*)[.][^.]*$', 1)"
    email = f"try_element_at(transform(array({local}), h -> concat({_moved('h', _classes(far=True), key('email'), far=True)}, '.', substring_index({m}, '.', -1))), 1)"
    iban = _moved(m, _classes(), key("iban"), f"substr({m}, 1, 2)")
    return f"""CASE {_type_of(m, patterns)} WHEN 'email' THEN {email} WHEN 'secret' THEN {secret} WHEN 'iban' THEN {iban}
        WHEN 'ip' THEN {_ip(m, key('ip'))} WHEN 'ip6' THEN {_moved(m, _classes(hexadecimal=True), key('ip6'))} WHEN 'card' THEN {card}
        WHEN 'ssn' THEN {_moved(m, _classes(digits_only=True), key('ssn'))} WHEN 'phone' THEN {phone} WHEN 'person' THEN {_person(m, patterns, keys, family_here)} ELSE {m} END"""


def subkeys(key: str | bytes) -> dict[str, str]:
    """A key for each kind of entity, by HMAC-SHA-256 of the kind with the secret key, which has at least 16 bytes."""
    key = key.encode() if isinstance(key, str) else key
    if len(key) < 16:
        raise ValueError("the key needs at least 16 bytes")
    return {k: hmac.new(key, k.encode(), hashlib.sha256).hexdigest() for k in KINDS}


def _with_keys(df: DataFrame, key: str | bytes, name: str) -> DataFrame:
    """The rows with a struct of the subkeys, from a table of one row: as literals they would stand in plans and logs."""
    on, zero, keys = spare_name(df, "_one"), spare_name(df, "_zero"), subkeys(key)
    kind = f"struct<{','.join(f'{k}:string' for k in keys)}>"
    table = df.sparkSession.createDataFrame([(0, tuple(keys.values()))], f"{zero} int, {name} {kind}")
    # 0 for every row, but not a constant, which would make this a join without a condition
    same = F.pmod(F.xxhash64(F.col(f"`{df.columns[0]}`")), F.lit(1)).cast("int")
    return df.withColumn(on, same).join(F.broadcast(table), F.col(on) == F.col(zero), "left").drop(on, zero)


def _found(text: Column, patterns: Patterns) -> Column:
    """What the entity expression matches, in order."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(text.rlike(_DIGIT_OR_AT) | text.rlike(patterns.start), F.regexp_extract_all(text, F.lit(patterns.entity), F.lit(0))), none)


def _detected(df: DataFrame, names: tuple[str, str, str], patterns: Patterns) -> DataFrame:
    """The rows with their matches, the family names of the text's full names, and where it has persons, the expression that also matches their names alone."""
    found, family, rule = names
    df = df.withColumn(found, _found(F.col("text"), patterns))
    persons = f"filter({found}, m -> m RLIKE {_q('^(?:' + patterns.person + ')$')})"
    plain = f"transform({persons}, m -> filter(split(m, ' '), w -> NOT w RLIKE '^({'|'.join(TITLES)})[.]?$'))"
    df = df.withColumn(rule, F.expr(f"array_distinct(flatten({plain}))"))
    df = df.withColumn(family, F.expr(f"array_distinct(transform(filter({plain}, x -> size(x) > 0), x -> try_element_at(x, -1)))"))
    alone = F.concat(F.lit(patterns.entity + r"|(?<!\p{L})(?:"), F.array_join(rule, "|"), F.lit(r")(?!\p{L})"))
    df = df.withColumn(rule, F.when(F.size(rule) > 0, alone))
    again = F.regexp_extract_all(F.col("text"), F.col(rule), F.lit(0))
    return df.withColumn(found, F.when(F.col(rule).isNotNull(), again).otherwise(F.col(found)))


def entities(text: Column | str = "text", patterns: Patterns | None = None) -> Column:
    """The entities of a text in order, without names that stand alone."""
    patterns = patterns or _default_patterns()
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.isNotNull(), F.filter(_found(c, patterns), lambda m: ~m.rlike(f"^(?:{CARD})$") | F.call_function("luhn_check", F.regexp_replace(m, "[^0-9]", ""))))


def surrogates(docs: DataFrame, key: str | bytes, names: dict[str, list[str]] | None = None) -> DataFrame:
    """The documents' columns with entities replaced in ``text``, and n_entities and entity_types.

    ``key`` is a secret of at least 16 bytes: with another key all surrogates are others. ``names`` are
    lists of person names in the form of ``NAMES``. Null texts stay null and have 0 entities.
    entity_types is the sorted comma-joined list of types. Whole texts are read, however long; repeated
    rows come out alike; an empty table stays empty. One pass over the rows, without a shuffle; n_chars,
    where present, is renewed. Columns of the same names as the two new ones are replaced; all others
    may have any name.
    """
    patterns = Patterns(names) if names is not None else _default_patterns()
    kept = [c for c in docs.columns if c.lower() not in ("n_entities", "entity_types")]
    found, family, rule, keys, new, text, types = (spare_name(docs, x) for x in ("_found", "_family", "_rule", "_keys", "_new", "_text", "_types"))
    d = _detected(_with_keys(docs, key, keys), (found, family, rule), patterns)
    d = d.withColumn(types, F.expr(f"filter(transform({found}, m -> {_type_of('m', patterns)}), t -> t IS NOT NULL)"))
    d = d.withColumn(new, F.expr(f"transform({found}, m -> {surrogate_sql('m', keys, family, patterns)})"))
    # a document without entities is not split; between the entities stand the split's pieces
    pieces = F.when(F.col(rule).isNull(), F.split("text", patterns.entity, -1)).otherwise(F.split(F.col("text"), F.col(rule), -1))
    replaced = F.array_join(F.flatten(F.zip_with(pieces, F.col(new), lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")
    d = d.withColumn(text, F.when(F.size(found) == 0, F.col("text")).otherwise(replaced))

    def column(c):
        if c == "text":
            return F.col(text).alias(c)
        if c == "n_chars":
            return F.when(F.size(found) == 0, F.col(f"`{c}`")).otherwise(F.length(text)).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"`{c}`")

    return d.select(*(column(c) for c in kept), F.size(types).cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(types)), ",").alias("entity_types"))


def entity_table(docs: DataFrame, key: str | bytes, names: dict[str, list[str]] | None = None) -> DataFrame:
    """(type, entity, surrogate, documents), one row an entity; a name that stands alone is an entity of its own, as a family or a given name."""
    patterns = Patterns(names) if names is not None else _default_patterns()
    kind = F.expr(_type_of("entity", patterns))
    e = _detected(docs.select("doc_id", "text"), ("_found", "_family", "_rule"), patterns)
    e = e.select("_family", F.explode(F.array_distinct("_found")).alias("entity")).withColumn("type", kind).where("type IS NOT NULL")
    e = e.withColumn("_family", F.expr("if(type = 'person' AND array_contains(_family, entity), array(entity), array())").cast("array<string>"))
    e = e.groupBy("type", "entity", "_family").agg(F.count("*").alias("documents"))
    surrogate = F.expr(f"try_element_at(transform(array(entity), m -> {surrogate_sql('m', '_keys', '_family', patterns)}), 1)")
    return _with_keys(e, key, "_keys").select("type", "entity", surrogate.alias("surrogate"), "documents")


def collisions(docs: DataFrame, key: str | bytes, names: dict[str, list[str]] | None = None) -> DataFrame:
    """(type, surrogate, entities): surrogates shared by entities of a type, or equal to their entity; no rows are expected."""
    t = entity_table(docs, key, names)
    g = t.groupBy("type", "surrogate").agg(F.count_distinct("entity").alias("entities"), F.max((F.col("entity") == F.col("surrogate")).cast("int")).alias("same"))
    return g.where("entities > 1 OR same = 1")
