"""Cutting texts into sections (T1-T11, S21): by boundary pattern, marker, page, table row or size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_CHARS = 600_000
TABLE_ROWS = 100
SLICE_CHARS = 1 << 20


def by_boundary(df: DataFrame, pattern: str, column: str = "text") -> DataFrame:
    """A section from each match to the next; what precedes the first is dropped. The pattern's first group is the sub-account."""
    parts = F.split(F.col(column), f"(?={pattern})")
    return df.select("*", F.posexplode(parts).alias("section", "section_text")).filter(F.col("section_text").rlike(f"^(?:{pattern})")).withColumn("sub_account", F.regexp_extract("section_text", pattern, 1))


def by_markers(df: DataFrame, markers: list[str], column: str = "text") -> DataFrame:
    """A section from each marker line to the next, named by it."""
    escaped = "|".join("".join("\\" + ch if not ch.isalnum() else ch for ch in m) for m in markers)
    out = by_boundary(df, f"({escaped})", column)
    return out.withColumn("section_name", F.lower(F.trim(F.regexp_replace("sub_account", "-{3}", "")))).drop("sub_account")


def by_pages(pages: DataFrame, per_chunk: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pages (from 0) in groups; groups without text are left out."""
    out = pages.groupBy(*keys, F.floor(F.col("page") / per_chunk).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("text"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    return out.filter(F.trim("text") != "")


def by_rows(rows: DataFrame, row: str = "row", size: int = TABLE_ROWS) -> DataFrame:
    """T5: the number of the table chunk of each row."""
    return rows.withColumn("chunk", F.floor(F.col(row) / size).cast("int"))


def page_groups(pages: Column, size: int = 3) -> Column:
    """First pages of the groups of a scanned document."""
    return F.when(pages > 0, F.sequence(F.lit(0), pages - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))


def packed(text: str, most: int) -> list[str]:
    """T4: paragraphs packed while they fit; too long ones by lines; too long lines cut."""
    def pack(parts: list[str], sep: str, split) -> list[str]:
        out: list[str] = []
        now = None
        for p in parts:
            if len(p) > most:
                if now is not None:
                    out.append(now)
                    now = None
                out += split(p)
            elif now is not None and len(now) + len(sep) + len(p) <= most:
                now += sep + p
            else:
                if now is not None:
                    out.append(now)
                now = p
        return out + ([now] if now is not None else [])

    if len(text) <= most:
        return [text]
    return pack(text.split("\n\n"), "\n\n", lambda p: pack(p.split("\n"), "\n", lambda s: [s[i : i + most] for i in range(0, len(s), most)]))


def by_size(df: DataFrame, most: int = MOST_CHARS, column: str = "text") -> DataFrame:
    """T4: part, part_text. Texts within the limit never leave the JVM's rows; of the others Python holds the parts of some 1 MB at a time."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, parts, held = 0, [], 0
            for i, t in enumerate(batch.column(at)):
                parts.append(packed(t.as_py() or "", most))
                held += sum(map(len, parts[-1]))
                if held >= SLICE_CHARS or i == batch.num_rows - 1:
                    own = batch.slice(begin, len(parts))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(parts, pa.list_(pa.string()))], names=[*own.schema.names, "_parts"])
                    begin, parts, held = i + 1, [], 0

    small = F.coalesce(F.length(column), F.lit(0)) <= most
    whole = df.filter(small).withColumns({"part": F.lit(0), "part_text": F.coalesce(column, F.lit(""))})
    cut = df.filter(~small).mapInArrow(run, T.StructType([*df.schema, T.StructField("_parts", T.ArrayType(T.StringType()))]))
    return whole.unionByName(cut.select(*df.columns, F.posexplode("_parts").alias("part", "part_text")))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once a row however often f names it: within functions of arrays an expression is computed wherever it stands."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _last_of(entries: Column, key: str) -> Column:
    """Of entries with the same key the last one, in the order of first ones. Where keys repeat, places are sorted by key: the first and the last
    place of each run."""
    def of_runs(es: Column) -> Column:
        def picked(s: Column) -> Column:
            heads = F.filter(s, lambda x, i: ~x["k"].eqNullSafe(F.get(s, i - 1)["k"]))
            ends = F.filter(s, lambda x, i: ~x["k"].eqNullSafe(F.get(s, i + 1)["k"]))
            return F.transform(F.sort_array(F.zip_with(heads, ends, lambda a, b: F.struct(a["i"].alias("first"), b["i"].alias("last")))), lambda x: F.get(es, x["last"]))

        return _once(F.sort_array(F.transform(es, lambda e, i: F.struct(e[key].alias("k"), i.alias("i")))), picked)

    return _once(entries, lambda es: F.when(F.size(F.array_distinct(F.transform(es, lambda e: e[key]))) == F.size(es), es).otherwise(of_runs(es)))


def location_totals(text: Column) -> Column:
    """Accounts and totals of the location summary: its lines, from the one below the title to an empty line or ACTIVITY FOR, that begin
    with five digits; the last amount of a line is its total. Without such an end there is no summary; of equal accounts the last line counts."""
    block = F.regexp_extract(text, r"(?s)LOCATION SUMMARY[^\n]*\n(.*?)(?=\n\n|\nACTIVITY FOR)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\s*\d{5}") & x.rlike(r"\$[\d,]+\.\d{2}"))
    total = lambda x: F.translate(F.element_at(F.regexp_extract_all(x, F.lit(r"\$[\d,]+\.\d{2}"), 0), -1), "$,", "").cast("double")
    return _last_of(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*(\S+)", 1).alias("account"), total(x).alias("total"))), "account")


def revenue_total(text: Column) -> Column:
    """The local service total of the revenue block, which ends at the next dashes; else null."""
    block = F.regexp_extract(text, r"(?s)---REVENUE AMOUNTS---\s*(.*?)(?=---|\z)", 1)
    return F.regexp_extract(block, r"LOCAL SERVICE TOTAL\s+([\d.]+)", 1).try_cast("double")


def code_descriptions(text: Column) -> Column:
    """Codes and what they stand for, from the boxes `! ! 1 !CODE What it is !` of the account summary, up to its closing rule."""
    block = F.regexp_extract(text, r"(?s)SERV & EQUIP ACCOUNT SUMMARY(.*?)(?=!-{10,}|\z)", 1)
    box = r"!\s*\d+\s*!(\w+)\s+(.+?)!"
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(box))
    return _last_of(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, box, 1).alias("code"), F.trim(F.regexp_extract(x, box, 2)).alias("description"))), "code")


def _place(address: Column) -> Column:
    """address, city: parted at the last comma."""
    bare = F.trim(F.rtrim(F.trim(address), F.lit(",")))
    return _once(bare, lambda b: F.struct(F.trim(F.regexp_replace(b, r"(?s),[^,]*$", "")).alias("address"), F.when(b.contains(","), F.trim(F.regexp_extract(b, r"([^,]*)$", 1))).alias("city")))


STATION = r"\bSLA\s+[!|](\d+)[-–]([^!\n]+)"


def _found(text: Column, pattern: str) -> Column:
    """The pattern's first group where it first matches; else null."""
    return F.get(F.regexp_extract_all(text, F.lit(f"(?s){pattern}.*+"), 1), F.lit(0))


def _stations(text: Column) -> Column:
    """The SLA entries: station, address, city."""
    entry = lambda x: F.regexp_replace(F.rtrim(F.trim(F.regexp_extract(x, STATION, 2)), F.lit(",")), r"\s*/(?:LSO|DPI|SN)\b.*$", "")
    told = lambda x: _once(_place(entry(x)), lambda p: F.struct(F.regexp_extract(x, STATION, 1).alias("station"), p["address"].alias("address"), p["city"].alias("city")))
    return F.transform(F.regexp_extract_all(text, F.lit(STATION), 0), told)


def _main(text: Column) -> Column:
    """The address and city of the record's SA, else its LA; null without one."""
    main = F.coalesce(_found(text, r"\bSA\s+[!|]([^!\n]+)"), _found(text, r"\bLA\s+[!|]([^!\n]+)"))
    return _once(main, lambda m: F.when(m.isNotNull(), _place(m)))


def address_table(text: Column) -> Column:
    """What a record in boxes says of places: main (address, city) of its SA, else its LA; zip of its DZIP; stations (station, address, city)
    of its SLA entries, without what follows /LSO, /DPI or /SN; contracts of its /CNUM marks, each once, sorted. Null or empty where it doesn't say."""
    contracts = lambda t: F.sort_array(F.array_distinct(F.regexp_extract_all(t, F.lit(r"/CNUM\s+(\S+)"), 1)))
    zip_code = lambda m, t: F.when(m.isNotNull(), _found(t, r"\bDZIP\s+[!|](\d+)"))
    return _once(text, lambda t: _once(_main(t), lambda m: F.struct(m.alias("main"), zip_code(m, t).alias("zip"), _stations(t).alias("stations"), contracts(t).alias("contracts"))))


def address_context(table: Column) -> Column:
    """The table as text for an extraction provider; empty if it says nothing."""
    line = lambda label, value: F.when(value != "", F.concat(F.lit(label), value))
    station = lambda s: F.concat(F.lit("  SLA "), s["station"], F.lit(" = "), s["address"], F.coalesce(F.concat(F.lit(", "), s["city"]), F.lit("")))

    def lines(t: Column) -> Column:
        more = F.size(t["contracts"]) > 1
        return F.array(
            F.when(t["main"].isNotNull(), F.concat(F.lit("DEFAULT_ADDRESS: "), t["main"]["address"])), line("DEFAULT_CITY: ", t["main"]["city"]), line("DEFAULT_ZIP: ", t["zip"]),
            F.when(F.size(t["stations"]) > 0, F.concat(F.lit("SLA_LOOKUP_TABLE:\n"), F.array_join(F.transform(t["stations"], station), "\n"))), line("CONTRACT_NUMBER: ", F.get(t["contracts"], F.lit(0))),
            F.when(more, F.concat(F.lit("CONTRACT_NUMBERS_ALT: "), F.array_join(F.slice(t["contracts"], F.lit(2), F.greatest(F.size(t["contracts"]) - 1, F.lit(0))), ", "))))

    said = F.filter(_once(table, lines), lambda x: x.isNotNull())
    return _once(said, lambda s: F.when(F.size(s) > 0, F.concat(F.lit("\n--- ADDRESS LOOKUP TABLE ---\n"), F.array_join(s, "\n"), F.lit("\n--- END ADDRESS TABLE ---\n"))).otherwise(""))


def placed_lines(docs: DataFrame, doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """doc_id, line, line_text, station, address, city: each line of a record, with the place of the station that its /SLA names, else the
    record's main one. Entries and lines of a record are made in one pass and sorted by station, entries first: a line takes the last entry
    before it, so of equal stations the last one counts. Records without an id have their main place only."""
    line = lambda t, m: F.transform(F.split(t, "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("line_text"), _found(x, r"/SLA\s+(\d+)").alias("station"), F.lit(None).cast("int").alias("entry"), m.alias("place")))
    entry = lambda t: F.transform(_stations(t), lambda s, i: F.struct(F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("line_text"), s["station"].alias("station"), i.alias("entry"), F.struct(s["address"].alias("address"), s["city"].alias("city")).alias("place")))
    rows = docs.select(doc_id, F.inline(_once(F.col(column), lambda t: _once(_main(t), lambda m: F.concat(entry(t), line(t, m))))))
    above = Window.partitionBy(doc_id, "station").orderBy(F.col("entry").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.last(F.when(F.col("entry").isNotNull() & F.col(doc_id).isNotNull(), F.col("place")), ignorenulls=True).over(above)
    placed = rows.withColumn("place", F.coalesce(own, F.col("place"))).filter("entry is null")
    return placed.select(doc_id, "line", "line_text", "station", "place.address", "place.city")


def context(carrier: Column, text: Column, size: int = 500) -> Column:
    """T9."""
    return F.concat(F.lit("Carrier: "), carrier, F.lit("\n"), F.substring(text, 1, size))


def summary_section(name: Column, text: Column) -> Column:
    """As JSON, what the section that a format names for validation says; null if it says nothing or the name is unknown."""
    told = lambda label, entries: _once(entries, lambda e: F.when(F.size(e) > 0, F.to_json(F.struct(F.map_from_entries(e).alias(label)))))
    return (
        F.when(name == "LOCATION SUMMARY", told("location_summary", location_totals(text)))
        .when(name == "---REVENUE AMOUNTS---", _once(revenue_total(text), lambda r: F.when(r.isNotNull(), F.to_json(F.struct(r.alias("revenue_total"))))))
        .when(name == "SERV & EQUIP ACCOUNT SUMMARY", told("usoc_summary", code_descriptions(text))))


def address_lines(addresses: Column) -> Column:
    """A map of accounts and their blocks of text as lines, without blank ones and branch codes of at most six letters."""
    code = lambda x: (F.length(x) <= 6) & x.rlike(r"^\p{L}+$")
    block = lambda e: F.concat(F.array(F.concat(F.lit("  Account "), e["key"], F.lit(":"))), F.transform(F.filter(F.transform(F.split(F.coalesce(e["value"], F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: (x != "") & ~code(x)), lambda x: F.concat(F.lit("    "), x)))
    return F.flatten(F.transform(F.map_entries(addresses), block))


def prompt(carrier: Column, kind: Column, body: Column, codes: Column, examples: Column, hints: Column, field_codes: Column | None = None, addresses: Column | None = None) -> Column:
    """What an extraction provider is given, with its caps: 50 codes, 30 field codes, 3 examples, 10 hints; addresses as a map by account."""
    part = lambda title, items, most: F.when(F.size(items) > 0, F.concat(F.lit(f"\n{title}:\n"), F.array_join(F.slice(items, 1, most), "\n"))).otherwise("")
    return F.concat(F.lit("Carrier: "), carrier, F.lit("\nDocument: "), kind, part("Codes", codes, 50), *([part("Field codes", field_codes, 30)] if field_codes is not None else []), part("Examples", examples, 3), part("Corrections", hints, 10), *([part("Service locations", address_lines(addresses), 1 << 30)] if addresses is not None else []), F.lit("\n\n"), body)


# Fixed value: a line with one of these, in any case, ends an address block.
ADDRESS_STOPS = r"(?i)AccountNumber:|TotalForAccount|MonthlyCharges|SecurityCode:|ChargeDetails|Date\s+Description|Subtotal|PastDue"


def _above(lines: Column, line: Column, most: int) -> Column:
    """The lines right above a line (from 0), upwards to an empty or a stop line."""
    def own(near: Column) -> Column:
        end = F.array_position(F.transform(near, lambda x: x["stop"]), True).cast("int")
        return _once(end, lambda e: F.when(e > 0, F.slice(near, F.lit(1), F.greatest(e - 1, F.lit(0)))).otherwise(near))

    near = F.reverse(F.slice(lines, F.greatest(line - most + 1, F.lit(1)), F.least(line, F.lit(most))))
    return F.array_join(F.reverse(F.transform(_once(near, own), lambda x: x["said"])), "\n")


def address_blocks(text: Column, pattern: str, most: int = 5) -> Column:
    """Of every place where the pattern matches the account (its first group) and the address above: at most five lines, which end at an
    empty line or one of charges. Without an account or a line there is no entry; of equal accounts the last one counts.

    Text and lines are cut once, and each line is judged once: a piece from match to match begins in a known line, whose lines above are a slice.
    Piece j begins in line g - j, where g counts the lines of the pieces before, since each piece but the first begins within a line."""
    def found(t: Column) -> Column:
        pieces = F.split(t["text"], f"(?={pattern})")
        return _once(pieces, lambda ps: F.filter(F.transform(begins(ps), lambda b: entry(F.get(ps, b["piece"]), b["line"], t["lines"])), lambda e: (e["account"] != "") & (e["address"] != "")))

    def begins(ps: Column) -> Column:
        heads = F.flatten(F.transform(ps, lambda p, j: F.transform(F.split(p, "\n"), lambda _, i: F.when(i == 0, j))))
        return F.filter(F.transform(heads, lambda j, g: F.struct(j.alias("piece"), (g - j).alias("line"))), lambda b: b["piece"].isNotNull())

    def entry(piece: Column, line: Column, lines: Column) -> Column:
        account = F.regexp_extract(piece, f"^(?:{pattern})", 1)
        return _once(account, lambda a: F.struct(a.alias("account"), F.when(a != "", _above(lines, line, most)).otherwise("").alias("address")))

    def judged(t: Column) -> Column:
        return F.struct(t.alias("text"), F.transform(F.split(t, "\n"), lambda x: F.struct(F.trim(x).alias("said"), ((F.trim(x) == "") | x.rlike(ADDRESS_STOPS)).alias("stop"))).alias("lines"))

    return _last_of(_once(_once(text, judged), found), "account")
