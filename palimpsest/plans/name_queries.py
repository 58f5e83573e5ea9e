"""Registered queries on gates of names, proposals from context, parties first, and invented names."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import gates, render
from ..functions.gates import as_column
from ..functions.names import parse
from ..operators import harvest, metrics, parties, people, registry, spans
from ..storage import partitions_for
from . import lines
from .catalog import _FIRST, _LAST, _SPANS, ORACLE_SQL, QUERIES, _line_spans, _names, query, table
from .lines import Digits, found


def _cases(spark, sf_dir, values: dict[str, str]):
    """id, case and value: every customer's key in every case's value (where it holds "{k}")."""
    made = F.array(*[F.struct(F.lit(n).alias("case"), F.replace(F.lit(v), F.lit("{k}"), (F.col("c_custkey") % 100).cast("string")).alias("value")) for n, v in values.items()])
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(made).alias("m")).select("id", "m.case", "m.value")


def _case_sql(values: dict[str, object], name: str) -> str:
    quoted = lambda x: str(x).lower() if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"
    return " union all ".join(f"select c_custkey as id, '{n}' as \"case\", {quoted(v)} as {name} from customer" for n, v in values.items())


#: For each gate: values, and what it says of them.
PERSONS = {
    "plain": ("Jane Roe", True), "initial": ("Jane Q. Roe", True), "account": ("Jane Savings", False), "digits": ("Jane Roe {k}", False), "mask": ("Jane XXXX", False), "bank": ("Roe Bank", False),
    "role": ("Jane Petitioner", False), "short": ("Roe", False), "single": ("Roebuck", True), "street": ("12 Oak Lane", False), "tail": ("Roe Holdings", False), "rail": ("Zelle Roe", False),
}
ADDRESSES = {"street": ("{k}1 Oak Lane", True), "grid": ("1{k} E 400 S", True), "box": ("PO Box {k}", True), "name": ("Jane Roe", False), "sum": ("{k} apples", False)}
BUSINESSES = {"llc": ("Roe Design LLC", True), "clinic": ("Oak {k} Clinic", True), "first": ("Company", False), "name": ("Jane Roe", False)}
TAILS = {"payment": ("Cody Roe Payment Ref", "Cody Roe"), "two": ("Cody Savings", "Cody Savings"), "none": ("Cody B Roe", "Cody B Roe")}
ORDINARY = {"function": ("The", True), "form": ("Amount", True), "role": ("Judge", True), "name": ("Roebuck", False)}
LIKELY = {"heading": ("Maturity Date", False), "rail": ("Spotify Usa", False), "given": ("Mike Miller", True), "known": ("Okon Design", True), "place": ("San Jose", False), "ordinary": ("Add Money", False), "name": ("Gustav Lindell", True)}
PROPOSED = {"long": ("a b c d e f", False), "short": ("Ro", False), "mask": ("XXXX Roe", False), "digits": ("A{k}0", False), "form": ("Statement", False), "name": ("Jane Roe", True)}
HOLDS = {"inside": ("instagram.com/janeroebuck{k}", True), "word": ("al.example.com", True), "part": ("algebra.example.com", False), "none": ("example.com/{k}", False)}

_GATES = {
    "p9_acceptable_person": (PERSONS, "fits", lambda v: gates.acceptable_person_col(v)),
    "p12_is_address": (ADDRESSES, "fits", lambda v: gates.is_address_col(v)),
    "p13_likely_name": (LIKELY, "fits", lambda v: gates.likely_name_col(v, F.lit("person"), known=("Okon",), places=("San Jose",))),
    "p14_ordinary_words": (ORDINARY, "fits", lambda v: gates.ordinary_col(v)),
    "p15_business": (BUSINESSES, "fits", lambda v: gates.is_business_col(v)),
    "p15_without_tail": (TAILS, "plain", lambda v: gates.without_tail_col(v)),
    "p16_holds_name": (HOLDS, "fits", lambda v: gates.holds_name_col(v, ("Roebuck", "Al"))),
    "p18_worth_proposing": (PROPOSED, "fits", lambda v: gates.worth_proposing_col(v, F.lit("person"))),
}


def _gated(cases, name, gate):
    def run(spark, sf_dir):
        return _cases(spark, sf_dir, {n: v for n, (v, _) in cases.items()}).select("id", "case", gate(F.col("value")).alias(name))

    return run


for _query, (_values, _col, _gate) in _GATES.items():
    QUERIES[_query] = _gated(_values, _col, _gate)
    ORACLE_SQL[_query] = _case_sql({n: w for n, (_, w) in _values.items()}, _col)

_SCREEN = {"no_no": (False, "business", "other"), "no_yes": (False, "person", "person"), "no_silent": (False, None, "person"), "yes_no": (True, "business", "person"), "silent": (None, "business", "person")}


@query(_case_sql({n: w for n, (_, _, w) in _SCREEN.items()}, "label"))
def e3_name_screen(spark, sf_dir):
    label = as_column(gates.screen, T.StringType())
    made = F.array(*[F.struct(F.lit(n).alias("case"), F.lit(a).cast("boolean").alias("says"), F.lit(b).cast("string").alias("parsed")) for n, (a, b, _) in _SCREEN.items()])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(made).alias("m"))
    return rows.select("id", "m.case", label("m.says", "m.parsed").alias("label"))


# -- proposals --------------------------------------------------------------------------------
#: For each harvester lines with its findings; the kinds are the harvester's own.
HARVESTS = {
    "h1_caption_parties": {"roles": (found("party", "MARIA KELLER"), ",\n    Petitioner,\nv.\n", found("party", "JOHN NOVAK"), ",\n    Respondent. ", Digits(3)), "former": ("Petitioner ", found("party", "Maria Keller"), ", formerly known as ", found("former", "Maria Ortega"), ", ", Digits(3))},
    "h2_officials": {
        "title": ("Judge ", found("official", "Ingrid T. Halvors"), " ruled on ", Digits(3)), "after": (found("official", "Ingrid Halvors"), ", District Court Judge ", Digits(3)),
        "signed": ("BY THE COURT:\n\n______\n/s/ ", found("official", "Ingrid Halvors"), "\n", Digits(3)), "below": (found("official", "INGRID HALVORS"), "\nDISTRICT COURT JUDGE ", Digits(3)), "clerk": ("by ", found("official", "Petra Weiler"), ", Clerk of the Court ", Digits(3)),
    },
    "h3_children": {"born": ("the child ", found("child", "Lena Marlow"), " Born: November 2016, ", Digits(3)), "custody": ("sole custody of the minor child, ", found("child", "Kai Marlow"), ", is ", Digits(3))},
    "h4_places": {"resides": ("Mother resides in ", found("place", "Pleasant Grove"), ". ", Digits(3)), "zip": ("see\n", found("place", "West Jordan"), ", UT 84088\n", Digits(3)), "moved": ("They moved to ", found("place", "Roosevelt"), ". ", Digits(3)), "located": ("It is located in ", found("place", "Provo"), ". ", Digits(3)), "state": ("a house in ", found("place", "Ogden"), ", UT for ", Digits(3))},
    "h5_counterparties": {
        "rail": ("Zelle to ", found("counterparty", "Nora Feldstein"), " ", Digits(3)), "credit": ("ZELLE CREDIT ", found("counterparty", "PAULA BRANDT"), " ", Digits(3)), "check": ("CHECK 1042 TO ", found("counterparty", "D. MELZER"), " ", Digits(3)),
        "ach": ("ACH PMT FROM ", found("counterparty", "MARTIN OSTROW"), " ", Digits(3)), "star": ("PAYPAL *", found("counterparty", "WIESINGER"), " ", Digits(3)), "site": ("Website Payment - ", found("counterparty", "Hannes Bremer"), " ID: R", Digits(3)), "p2p": ("VENMO TYPE: P2P CO: ", found("counterparty", "GRETA LINDNER"), " $", Digits(3), ".00"),
        "none": ("WIRE TO BANK OF THE WEST ", Digits(3)),
    },
    "h7_holders": {"street": (found("holder", "HELGA V STROM"), "\n12469 W CENTER ST\n", Digits(3)), "card": ("New Charges  ", found("cardholder", "ALBERT KRAUSE"), " Card Ending 2-3", Digits(3)), "for": ("Statement for ", found("holder", "Irene Castell"), " ", Digits(3))},
    "h8_employers": {
        "field": ("Employer: ", found("employer", "Silverpine Optical Partners"), "\n", Digits(3)), "deposit": ("DIRECT DEP ", found("employer", "MERIDIAN HAULAGE"), " PAYROLL 2,", Digits(3), ".66"), "payroll": ("1/10 ", found("employer", "Eastgate Turbin"), " Payroll PPD ID: ", Digits(3)),
        "plan": (found("employer", "EASTGATE TURBINES"), " 401(K) SAVINGS PLAN ", Digits(3)), "stub": (found("employer", "GREEN HOLLOW SUPPLY ARTS HOUSE"), "\n595 S Bluff St\nEARNINGS STATEMENT\nNet Pay ", Digits(3)), "paid": ("Employer: Nora Feldstein\nZelle to ", found("counterparty", "Nora Feldstein"), " ", Digits(3)),
    },
    "h9_own_businesses": {"street": (found("business", "STROM ENTERPRISES LLC"), "\n2279 E 5950 S\n", Digits(3)), "bank": ("Lakeside Home Mortgage Co\n123 Main St\n", Digits(3)), "receiver": ("X DES:TRANSFER INDN:", found("business", "TALL PINES DESIGN CO"), " CO ID:1", Digits(3))},
    "h10_labelled_people": {"label": ("Borrower: ", found("person", "Jane Roebuck"), "\n", Digits(3)), "receiver": ("DES:X INDN:", found("receiver", "HELGA V STROM"), " CO ID:5", Digits(3))},
    "h11_activity": {
        "feed": ("Orbit Technologies   -$118.40\n", found("feed", "Selma Dorn"), "   +$75.00\n", Digits(3)), "ledger": ("Note   From   To\n", found("feed", "Ruth Hagen"), "   ", found("feed", "Viktor Sund"), "   +$64.20\n", Digits(3)),
        "sent": ("01/02 Sent   ", found("feed", "Paula Ekberg"), "   -$212.75 ", Digits(3)),
    },
}


def _harvested(made):
    def run(spark, sf_dir):
        keys = table(spark, sf_dir, "customer").select("c_custkey")
        # a few bytes, long in work: a small file is one task
        docs = lines.documents(keys.repartition(partitions_for(keys)), "c_custkey", made)
        # a harvester keeps a document's id; the line is told by its place among them
        order = F.create_map(*[F.lit(x) for i, n in enumerate(made) for x in (n, i)])
        back = F.create_map(*[F.lit(x) for i, n in enumerate(made) for x in (i, n)])
        out = harvest.harvest(docs.select((F.col("doc_id") * 100 + order[F.col("line")]).alias("doc_id"), "text"))
        return out.select(F.floor(F.col("doc_id") / 100).alias("doc_id"), back[(F.col("doc_id") % 100).cast("int")].alias("line"), F.col("kind").alias("category"), "value", "begin")

    return run


for _name, _made in HARVESTS.items():
    QUERIES[_name] = _harvested(_made)
    ORACLE_SQL[_name] = lines.expected_sql("customer", "c_custkey", _made)


@query("select c_custkey as doc_id, cast(0 as integer) as \"begin\", case when c_custkey % 2 = 0 then 'Pleasant Grove' else 'Provo' end as place from customer where c_custkey % 5 <> 0")
def j13_confirmed_places(spark, sf_dir):
    k = F.col("c_custkey")
    value = F.when(k % 5 == 0, "Whartlebury Heights").when(k % 2 == 0, "pleasant grove City").otherwise("Provo Utah")
    rows = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.lit("place").alias("kind"), value.alias("value"), F.lit(0).alias("begin"))
    return harvest.confirmed_places(rows, spark.createDataFrame([("Pleasant Grove",), ("Pleasant",), ("Provo",)], "name string"))


@query("""
with p as (select o_orderkey as doc_id, case o_custkey % 3 when 0 then 'business' when 1 then 'counterparty' else 'holder' end as kind, 'Value ' || chr(cast(65 + o_custkey % 20 as integer)) as value from orders),
b as (select kind, value, count(distinct doc_id) as documents, count(*) as finds, bool_and(doc_id % 2 = 0) as only_financial from p group by all)
select kind, value, 'medium' as confidence, documents, finds from b where value not in ('Value C', 'Value F') and not (kind = 'business' and only_financial)
""")
def h12_collected(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.when(c % 3 == 0, "business").when(c % 3 == 1, "counterparty").otherwise("holder").alias("kind"), F.concat(F.lit("Value "), F.char((65 + c % 20).cast("long"))).alias("value"), F.lit("medium").alias("confidence"), F.lit(0).alias("begin"))
    known = spark.createDataFrame([("value c",), ("Value F",)], "value string")
    return harvest.collect(rows, known, rows.where(F.col("doc_id") % 2 == 0).select("doc_id"))


# -- parties first ----------------------------------------------------------------------------
_FACTS = ("category", "bare", "key", "loan_line", "city_line", "above_key", "owner", "full_ssn", "tail", "masked", "transfer_line")
_RULES = {
    "leave": (dict(category="case_number", owner="A"), "untouched", None), "bare": (dict(category="credit_card", bare=True, key="K1"), "left", None), "form": (dict(category="phone", key="K1", owner="A"), "form", "K1"),
    "loan": (dict(category="bank_account", loan_line=True, owner="A"), "left", None), "city": (dict(category="street_address", city_line=True, above_key="K2", owner="A"), "form", "K2"), "lone_city": (dict(category="street_address", city_line=True, owner="A"), "left", None),
    "owner": (dict(category="email", owner="A", full_ssn=True), "new", "A"), "ssn": (dict(category="ssn", full_ssn=True), "new", "PARTIES"), "tail": (dict(category="ssn", tail=True), "new", "PARTIES"),
    "transfer": (dict(category="masked_account", masked=True, transfer_line=True), "new", "PARTIES"), "else": (dict(category="masked_account", masked=True), "left", None),
}


@query(" union all ".join(f"select c_custkey || '|{n}' as id, '{d}' as decision, {'null' if t is None else repr(t)} as target from customer" for n, (_, d, t) in _RULES.items()))
def j10_file_match(spark, sf_dir):
    kinds = {c: ("string" if c in ("category", "key", "above_key", "owner") else "boolean") for c in _FACTS}
    facts = F.array(*[F.struct(F.lit(n).alias("rule"), *[F.lit(f.get(c)).cast(t).alias(c) for c, t in kinds.items()]) for n, (f, _, _) in _RULES.items()])
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(facts).alias("f")).select("c_custkey", "f.*")
    return parties.file_match(rows.withColumn("id", F.concat_ws("|", F.col("c_custkey").cast("string"), "rule")))


@query("""
with n as (select c_custkey as k, '00' || cast(730000000 + c_custkey * 13 as varchar) as number from customer)
select k as doc_id, unnest([number, substr(number, 3), substr(number, 4)]) as run, number from n
""")
def j8_bare_digits(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.concat(F.lit("00"), (F.lit(730000000) + k * 13).cast("string")).alias("number"))
    text = F.concat(F.lit("scan "), "number", F.lit(" then "), F.substring("number", 3, 20), F.lit(" or "), F.substring("number", 4, 20), F.lit(" not 1,"), F.substring("number", 4, 3))
    return parties.bare_digits(rows.select("doc_id", text.alias("text")), rows.select("number"))


@query(f"select distinct token, part from (select unnest([upper(replace(l, 'l', '1')), l || 's', substr(l, 1, 4) || substr(l, 6)]) as token, l as part from (select unnest({[x + 'berg' for x in _LAST]}) as l)) where lower(token) <> lower(part)")
def j6_misread_pieces(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.concat(_names()[2], F.lit("berg")).alias("part")).distinct()
    made = F.array(F.upper(F.replace("part", F.lit("l"), F.lit("1"))), F.concat("part", F.lit("s")), F.concat(F.substring("part", 1, 4), F.substring("part", 6, 99)), F.lit("Unrelated"))
    return people.misread_pieces(rows.select(F.explode(made).alias("token")), rows)


@query("select 'Ingrid T. Halvors' as name, 'Ingrid T. Halvors' as term union all select 'Petra Weiler', 'Petra Weiler' union all select 'Petra Weiler', 'Weiler' union all select 'Bo Roe', 'Bo Roe' where exists (select 1 from customer)")
def j16_protected_officials(spark, sf_dir):
    """A party's namesake goes, a last name that a party bears stays whole only, a short one too."""
    one = table(spark, sf_dir, "customer").limit(1).select(F.explode(F.array(*map(F.lit, ("Ingrid T. Halvors", "Petra Weiler", "Maria Keller", "Bo Roe")))).alias("name"))
    sheet = table(spark, sf_dir, "customer").select(F.concat_ws(" ", *(_names()[i] for i in (0, 2))).alias("name")).distinct().unionByName(spark.createDataFrame([("Peter Halvors",)], "name string"))
    return people.protected_officials(one, sheet)


@query(f"with n as (select distinct {_FIRST}[c_custkey % {len(_FIRST)} + 1] as f, {_LAST}[c_custkey % {len(_LAST)} + 1] as l from customer) select l || ' ' || f as inner, 'Anna ' || l || ' ' || f as outer from n")
def j17_overlapping_names(spark, sf_dir):
    f, _, l = _names()  # noqa: E741
    rows = table(spark, sf_dir, "customer").select(F.concat_ws(" ", l, f).alias("name")).distinct()
    out = people.overlapping_names(rows.unionByName(rows.select(F.concat(F.lit("Anna "), "name").alias("name"))))
    return out


@query("""
with d as (select count(*) as n from customer) select 'P1' as party, unnest(['Rebecca Keller', 'Becky Keller', 'R. Keller', 'Rehecca Keller', 'RebeccaKeller']) as form, unnest(['same', 'short', 'initial', 'misread', 'glued']) as how, n as documents from d
""")
def j19_party_forms(spark, sf_dir):
    text = F.lit("Rebecca Keller met Becky Keller, R. Keller and Rehecca Keller; RebeccaKeller paid Sue Keller")
    sheet = spark.createDataFrame([("P1", "Rebecca", "Keller")], "party string, first string, last string")
    return people.party_forms(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text")), sheet)


_CAPTION = "IN THE COURT|MARIA KELLER,|  of Provo,|Petitioner,|v.|JOHN NOVAK|PETER ORTEGA,|Respondent."


@query("select c_custkey as doc_id, unnest(['MARIA KELLER', 'PETER ORTEGA', 'JOHN NOVAK']) as name, unnest(['PETITIONER', 'RESPONDENT', 'RESPONDENT']) as role from customer")
def j20_caption_roles(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(F.split(F.lit(_CAPTION.removeprefix("IN THE COURT|")), r"\|")).alias("line_no", "text"))
    return people.caption_roles(rows)


@query("select c_custkey as doc_id, unnest(['Lena Ruth Marlow', 'Theo Marlow']) as name, unnest(['November 2016', '05/21/2019']) as born from customer where c_custkey % 3 <> 0")
def j21_child_roster(spark, sf_dir):
    """Documents whose key is divisible by three have no cue, only the bare word."""
    k = F.col("c_custkey")
    cue = F.when(k % 3 == 0, "cases involving the parties' children.").otherwise("The petition concerned the following child.")
    text = F.array(cue, F.lit("prose"), F.lit("Lena Ruth Marlow Born: November 2016"), F.lit("a. Theo Marlow Born 05/21/2019"), *[F.lit("prose")] * 9, F.lit("Late Comer Born: May 2001"))
    return people.children_below_cues(table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.posexplode(text).alias("line_no", "text")))


@query(f"""
with c as (select distinct cast(c_custkey as varchar) as set_id, {_LAST}[c_custkey % {len(_LAST)} + 1] as l from customer)
select set_id, 'person' as category, 'Daniel R. ' || l as name, 'Dan ' || l || '|Daniel R. ' || l || '|' || l || ', Daniel' as forms from c
union all select set_id, 'person', 'Daniel ' || l || ' Reed', 'Daniel ' || l || ' Reed' from c union all select set_id, 'minor', 'Daniel ' || l, 'Daniel ' || l from c union all select set_id, 'person', 'Daniel Rowan ' || l, 'Daniel Rowan ' || l from c
""")
def a2_person_registry(spark, sf_dir):
    """A father's forms join; a son who is listed apart, a child of another category and another last name don't."""
    l = _names()[2]  # noqa: E741
    made = [("person", "Daniel R. {l}", False), ("person", "Dan {l}", False), ("person", "{l}, Daniel", False), ("person", "Daniel {l} Reed", False), ("minor", "Daniel {l}", False), ("person", "Daniel Rowan {l}", True)]
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.replace(F.lit(n), F.lit("{l}"), l).alias("name"), F.lit(a).alias("apart")) for c, n, a in made])
    names_ = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("set_id"), F.explode(rows).alias("m")).select("set_id", "m.*")
    return people.person_registry(names_).withColumn("forms", F.array_join("forms", "|"))


# -- invented names, keys ---------------------------------------------------------------------
_SHAPES = {"whole": ("{f} {l}", "Mabel Corwin"), "upper": ("{F} {L}", "MABEL CORWIN"), "turned": ("{l}, {f}", "Corwin, Mabel"), "initial": ("{i}. {l}", "M. Corwin"), "plural": ("the {l}s", "the Corwins"), "titled": ("Ms. {l}", "Ms. Corwin"), "first": ("{f}", "Mabel")}


@query(" union all ".join(f"select c_custkey as id, '{n}' as shape, '{w}' as made from customer" for n, (_, w) in _SHAPES.items()))
def f3_rendered_forms(spark, sf_dir):
    f, _, l = _names()  # noqa: E741
    put = as_column(lambda like, first, last: render.render(parse("Mabel Corwin"), like, parse(f"{first} {last}")), T.StringType())
    parts = {"{f}": f, "{l}": l, "{F}": F.upper(f), "{L}": F.upper(l), "{i}": F.substring(f, 1, 1)}

    def form(pattern):
        out = F.lit(pattern)
        for k, v in parts.items():
            out = F.replace(out, F.lit(k), v)
        return out

    made = F.array(*[F.struct(F.lit(n).alias("shape"), form(p).alias("like")) for n, (p, _) in _SHAPES.items()])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), f.alias("f"), l.alias("l"), F.explode(made).alias("m"))
    return rows.select("id", "m.shape", put("m.like", "f", "l").alias("made"))


_PARTIAL = {"glued": ("{f}{l}", "MabelCorwin"), "partial": ("{f}", "Mabel"), "other": ("Xavier {l}", None)}


@query(" union all ".join(f"select c_custkey as id, '{n}' as shape, {'null' if w is None else repr(w)} as made from customer" for n, (_, w) in _PARTIAL.items()))
def f27_partial_names(spark, sf_dir):
    f, _, l = _names()  # noqa: E741
    put = as_column(lambda like, real: render.shaped(like, real, "Mabel Corwin"), T.StringType())
    real = F.concat_ws(" ", f, l)
    made = F.array(*[F.struct(F.lit(n).alias("shape"), F.replace(F.replace(F.lit(p), F.lit("{f}"), f), F.lit("{l}"), l).alias("like")) for n, (p, _) in _PARTIAL.items()])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), real.alias("real"), F.explode(made).alias("m"))
    return rows.select("id", "m.shape", put("m.like", "real").alias("made"))


@query("select c_custkey as id, 'Corwin''s Food & Corwins ' || (c_custkey % 9) || ' LLC, ' || upper('Corwin') as made from customer")
def f28_swapped_surnames(spark, sf_dir):
    put = as_column(lambda text, last: render.surname_swapped(text, last, "Corwin"), T.StringType())
    _, _, l = _names()  # noqa: E741
    text = F.concat(l, F.lit("'s Food & "), l, F.lit("s "), (F.col("c_custkey") % 9).cast("string"), F.lit(" LLC, "), F.upper(l))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), put(text, l).alias("made"))


_COMPANY = {"as": ("Best {w} Co., Inc.", True), "upper": ("BEST {W} CO", True), "number": ("Best {w} #123", True), "prose": ("the best {x} of the year", False)}


@query(" union all ".join(f"select c_custkey as id, '{n}' as form, {str(w).lower()} as found from customer" for n, (_, w) in _COMPANY.items()))
def f22_company_forms(spark, sf_dir):
    w = F.initcap("c_mktsegment")
    pattern = as_column(render.company_pattern, T.StringType())
    made = F.array(*[F.struct(F.lit(n).alias("form"), F.replace(F.replace(F.replace(F.lit(t), F.lit("{w}"), w), F.lit("{W}"), F.upper(w)), F.lit("{x}"), F.lower(w)).alias("text")) for n, (t, _) in _COMPANY.items()])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), pattern(F.concat(F.lit("Best "), w, F.lit(" Co., Inc."))).alias("p"), F.explode(made).alias("m"))
    return rows.select("id", "m.form", F.regexp_like("m.text", F.col("p")).alias("found"))


@query("""
with k as (select c_custkey as id, lpad(cast(c_custkey as varchar), 7, '0') as d from customer)
select id, 'account' as kind, regexp_replace('00' || d, '^0+', '') as key from k union all select id, 'phone', '801' || d from k union all select id, 'email', 'roe' || id || '@example.com' from k
union all select id, 'business', 'roe design' from k union all select id, 'handle', 'roe' || id from k union all select id, 'vin', 'AB' || d from k union all select id, 'other', 'some value ' || id from k
""")
def f29_value_keys(spark, sf_dir):
    k = F.col("c_custkey")
    d = F.lpad(k.cast("string"), 7, "0")
    c = F.concat
    made = {"account": c(F.lit("00-"), d), "phone": c(F.lit("+1 (801) "), F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 4)), "email": c(F.lit("mailto:Roe"), k.cast("string"), F.lit("@Example.com")), "business": F.lit("The Roe Design, LLC"), "handle": c(F.lit("@Roe"), k.cast("string")), "vin": c(F.lit("ab-"), d), "other": c(F.lit("Some  value, "), k.cast("string"))}
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), v.alias("value")) for n, v in made.items()])).alias("m"))
    return rows.select("id", "m.kind", render.value_key(F.col("m.kind"), F.col("m.value")).alias("key"))


# -- spans, measures, numbers -----------------------------------------------------------------
def _grouped_spans(spark, sf_dir):
    return _line_spans(spark, sf_dir).withColumn("s", F.col("s").withField("group", F.col("s.priority") % 2)).groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("s.category") == "c1", F.col("s"))).alias("first"), F.collect_list(F.when(F.col("s.category") != "c1", F.col("s"))).alias("rest"))


@query(f"with s as ({_SPANS}) select l_orderkey, b as \"begin\", e as \"end\", category from s a where category <> 'c1' and (category = 'c2' or not exists (select 1 from s d where d.l_orderkey = a.l_orderkey and d.category = 'c1' and d.b <= a.b and a.e <= d.e))")
def i6_date_guard(spark, sf_dir):
    rows = _grouped_spans(spark, sf_dir)
    hits = F.transform("rest", lambda s: s.withField("category", F.when(s["category"] == "c2", "dob").otherwise(s["category"])))
    out = rows.select("l_orderkey", F.explode(spans.date_guard(hits, F.col("first"))).alias("m"))
    return out.select("l_orderkey", "m.begin", "m.end", F.when(F.col("m.category") == "dob", "c2").otherwise(F.col("m.category")).alias("category"))


@query(f"with s as ({_SPANS}) select l_orderkey, b as \"begin\", e as \"end\", category from s a where category <> 'c1' and not exists (select 1 from s d where d.l_orderkey = a.l_orderkey and d.category = 'c1' and d.p % 2 = a.p % 2 and d.b <= a.b and a.e <= d.e)")
def i7_held_back(spark, sf_dir):
    out = _grouped_spans(spark, sf_dir).select("l_orderkey", F.explode(spans.held_back(F.col("rest"), F.col("first"))).alias("m"))
    return out.select("l_orderkey", "m.begin", "m.end", "m.category")


@query(f"""
with s as (select l_orderkey, b, e, max(p) as sure from ({_SPANS}) group by all), k as (select * from s a where not exists (select 1 from s o where o.l_orderkey = a.l_orderkey and o.b <= a.b and a.e <= o.e and o.e - o.b > a.e - a.b and o.sure >= a.sure))
select l_orderkey, b as "begin", e as "end", sure from k
""")
def i9_one_leak_per_place(spark, sf_dir):
    rows = _line_spans(spark, sf_dir).select("l_orderkey", F.struct("s.begin", "s.end", F.col("s.priority").alias("sure")).alias("s")).groupBy("l_orderkey").agg(F.collect_list("s").alias("leaks"))
    return rows.select("l_orderkey", F.explode(spans.one_per_place(F.col("leaks"))).alias("m")).select("l_orderkey", "m.begin", "m.end", "m.sure")


@query("""
with l as (select l_orderkey as doc_id, 'w' || l_partkey % 5 as value, l_linenumber as k from lineitem), b as (select doc_id, value, count(*) as n from l group by all), a as (select doc_id, value, count(*) as n from l where k > 1 group by all)
select doc_id, value, b.n - coalesce(a.n, 0) as lost from b left join a using (doc_id, value) where b.n > coalesce(a.n, 0)
""")
def u1_lost_words(spark, sf_dir):
    def text(rows):
        l = table(spark, sf_dir, "lineitem").where(rows)  # noqa: E741
        return l.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.collect_list(F.concat(F.lit("w"), (F.col("l_partkey") % 5).cast("string"))), " ").alias("text"))

    return metrics.lost_values(text("true"), text("l_linenumber > 1"), r"\w+")


@query("""
with l as (select l_orderkey as doc_id, strftime(l_shipdate, '%m/%d/%Y') as value, l_linenumber as k from lineitem), b as (select doc_id, value, count(*) as n from l group by all), a as (select doc_id, value, count(*) as n from l where k > 1 group by all)
select doc_id, value, b.n - coalesce(a.n, 0) as lost from b left join a using (doc_id, value) where b.n > coalesce(a.n, 0)
""")
def u1_lost_dates(spark, sf_dir):
    def text(rows):
        l = table(spark, sf_dir, "lineitem").where(rows)  # noqa: E741
        return l.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.collect_list(F.date_format("l_shipdate", "MM/dd/yyyy")), ", ").alias("text"))

    return metrics.lost_values(text("true"), text("l_linenumber > 1"), "[0-9]{2}/[0-9]{2}/[0-9]{4}")


@query("""
with o as (select o_custkey as id, o_orderpriority as p, min(o_orderkey) as first from orders where o_orderkey % 7 <> 0 group by all)
select id, string_agg(p, '|' order by first) as priorities from o group by id
""")
def u3_distinct_in_order(spark, sf_dir):
    p = F.when(F.col("o_orderkey") % 7 == 0, F.lit(" ")).otherwise(F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", p.alias("p")))).alias("x"))
    out = rows.select("id", F.array_join(metrics.first_distinct(F.transform("x", lambda y: y["p"])), "|").alias("priorities"))
    return out.where("priorities <> ''")


@query("select o_custkey as id, bool_or(o_orderkey % 3 <> 0) as outside from orders group by o_custkey")
def u4_outside_documents(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(k).alias("docs"), F.collect_set(F.when(k % 3 == 0, k)).alias("financial"))
    return rows.select("id", metrics.outside(F.col("docs"), F.col("financial")).alias("outside"))


@query("select distinct o_custkey as set_id, o_orderpriority as kind, 'v' || o_orderkey % 10 as value from orders")
def u5_case_secrets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderpriority").alias("kind"), F.concat(F.lit(" v"), (F.col("o_orderkey") % 10).cast("string"), F.lit(" ")).alias("value"))
    return metrics.case_secrets(rows)


@query("select o_orderpriority as kind, count(distinct o_custkey) as values from orders group by 1")
def a18_left_counts(spark, sf_dir):
    return metrics.left_counts(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("value")))


@query("""
with v as (select o_custkey as owner, case o_orderkey % 3 when 0 then 'ssn' when 1 then 'phone' else 'account' end as kind, o_orderkey as value from orders)
select owner, case kind when 'ssn' then 1 when 'phone' then 6 else 10 end as kind_order, kind, row_number() over (partition by owner, kind order by value) as n, value from v
""")
def w7_numbered_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "ssn").when(k % 3 == 1, "phone").otherwise("account")
    return parties.numbered_rows(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), kind.alias("kind"), k.alias("seq"), k.alias("value")))


@query("""
with e as (select c_custkey as k, lpad(cast(c_custkey as varchar), 9, '0') as entity_key, 'R' || c_custkey % 40 as replacement from customer), r as (select *, row_number() over (partition by replacement order by entity_key) as r from e)
select entity_key, case when r > 1 then replacement || '-' || r else replacement end as replacement from r
""")
def w9_unique_replacements(spark, sf_dir):
    k = F.col("c_custkey")
    return registry.unique_replacements(table(spark, sf_dir, "customer").select(F.lpad(k.cast("string"), 9, "0").alias("entity_key"), F.concat(F.lit("R"), (k % 40).cast("string")).alias("replacement")))

