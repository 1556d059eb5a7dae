"""Configuration and state as tables: each file's text is a row, what can't be read says so in its row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How often macros within macros are looked up. A fixed value.
MACRO_PASSES = 3


def texts_at(spark, path: str) -> DataFrame:
    """(path, text) of each file, whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


_LINES = "struct<section:string,id:string,field:string,macros:array<struct<key:string,value:string>>,told:array<struct<id:string,field:string,line:string>>>"


def _unquoted(value: Column) -> Column:
    value = F.trim(value)
    quoted = (F.length(value) > 1) & F.substring(value, 1, 1).isin("'", '"') & (F.substring(value, 1, 1) == F.substring(value, -1, 1))
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def _line(line: Column) -> Column:
    """What a line says: text, depth, the name before its colon and what follows, each read once."""
    body = F.trim(line)
    return F.struct(
        body.alias("body"), (F.length(line) - F.length(F.ltrim(line))).alias("depth"),
        _unquoted(F.substring_index(body, ":", 1)).alias("name"), F.trim(F.regexp_replace(body, "^[^:]*:", "")).alias("rest"),
    )


def _noted(state: Column, line: Column) -> Column:
    """One more line: how far it is indented tells what it belongs to.

    At the margin a section begins; under models, two blanks in, a model does, and four in, one of its
    fields; what is further in goes on with that field. Under macros each line is a macro.
    """
    body, depth, name, rest = (line[x] for x in ("body", "depth", "name", "rest"))
    within = F.when(depth == 0, 0).when(state["section"] == "macros", 1).when(state["section"] != "models", 9).when(depth <= 2, 2).when(depth <= 4, 3).otherwise(4)
    opens = F.when(rest.isin("", "|", "|-", ">", ">-"), F.lit(None).cast("string")).otherwise(rest)
    macro = F.struct(name.alias("key"), _unquoted(rest).alias("value"))
    field = F.struct(state["id"].alias("id"), name.alias("field"), opens.alias("line"))
    more = F.struct(state["id"].alias("id"), state["field"].alias("field"), body.alias("line"))
    model = F.struct(name.alias("id"), F.lit("").alias("field"), F.lit(None).cast("string").alias("line"))
    nothing = F.lit(None).cast("string")
    changed = F.struct(
        F.when(within == 0, name).otherwise(state["section"]).alias("section"),
        F.when(within == 0, nothing).when(within == 2, name).otherwise(state["id"]).alias("id"),
        F.when(within.isin(0, 2), nothing).when(within == 3, name).otherwise(state["field"]).alias("field"),
        F.when(within == 1, F.array_append(state["macros"], macro)).otherwise(state["macros"]).alias("macros"),
        F.when(within == 2, F.array_append(state["told"], model))
        .when((within == 3) & state["id"].isNotNull(), F.array_append(state["told"], field))
        .when((within == 4) & state["field"].isNotNull(), F.array_append(state["told"], more))
        .otherwise(state["told"])
        .alias("told"),
    )
    return F.when((body == "") | body.startswith("#"), state).otherwise(changed.cast(_LINES))


def _listed(lines: Column) -> Column:
    """The values of a list, in brackets or a dash each."""
    inline = F.regexp_replace(F.array_join(F.filter(lines, lambda x: ~x.startswith("-")), " "), r"^\s*\[|\]\s*$", "")
    dashed = F.transform(F.filter(lines, lambda x: x.startswith("-")), lambda x: _unquoted(F.substring(x, F.lit(2), F.length(x))))
    return F.filter(F.concat(F.transform(F.split(inline, ","), _unquoted), dashed), lambda x: x != "")


def expanded(command: Column, macros: Column) -> Column:
    """``${name}`` replaced by what the last macro of that name says, and again what that brings; unknown names stay."""
    for _ in range(MACRO_PASSES):
        named = F.array_distinct(F.regexp_extract_all(command, F.lit(r"\$\{([^${}]+)\}"), F.lit(1)))

        def put(text: Column, name: Column) -> Column:
            said = F.try_element_at(F.filter(macros, lambda m: m["key"] == name), F.lit(-1))["value"]
            spot = F.concat(F.lit("${"), name, F.lit("}"))
            return F.replace(text, spot, F.coalesce(said, spot))

        command = F.aggregate(named, command, put)
    return command


def model_entries(configs: DataFrame, text: str, flags: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, id, name, aliases, command, flags) of each model in texts of the form

        macros:
          "name": "value"
        models:
          "id":
            name: "shown name"
            aliases: ["a", "b"]
            cmd: |
              words, ${name} stands for a macro

    Texts are read line by line, by indentation; lines may end in CR LF, quotes may be single or left out,
    lists may have a dash a line. Of macros, models' fields and flags given twice the last, the last and
    the first count; a model without a command has an empty one. ``flags`` that a command has are kept
    with the word that follows, of ``-m`` the last part of the path. A null text has no models.
    """
    none = F.lit(None).cast("string")
    start = F.struct(none.alias("section"), none.alias("id"), none.alias("field"), F.array().alias("macros"), F.array().alias("told")).cast(_LINES)
    lines = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")
    read = configs.select(*keep, F.aggregate(F.transform(lines, _line), start, _noted).alias("_read"))
    ids = F.array_distinct(F.transform("_read.told", lambda t: t["id"]))
    rows = read.select(*keep, "_read", F.explode(ids).alias("id"))
    own = F.filter("_read.told", lambda t: t["id"] == F.col("id"))

    def field(name: str) -> Column:
        return F.filter(F.transform(F.filter("_own", lambda t: t["field"] == name), lambda t: t["line"]), lambda x: x.isNotNull())

    rows = rows.withColumn("_own", own)
    rows = rows.withColumns({"_aliases": field("aliases"), "_name": F.try_element_at(field("name"), F.lit(-1)), "_cmd": F.array_join(field("cmd"), " ")})
    rows = rows.withColumn("command", expanded(F.col("_cmd"), F.col("_read.macros")))
    words = F.split("command", r"\s+")
    found = []
    for flag in flags:
        at = F.array_position(words, flag)
        value = F.when(at > 0, F.get(words, at.cast("int")))
        found.append(F.struct(F.lit(flag).alias("key"), (F.substring_index(value, "/", -1) if flag == "-m" else value).alias("value")))
    told = F.map_from_entries(F.filter(F.array(*found), lambda x: x["value"].isNotNull()))
    name = F.coalesce(F.nullif(_unquoted(F.col("_name")), F.lit("")), F.col("id"))
    return rows.select(*keep, "id", name.alias("name"), _listed(F.col("_aliases")).alias("aliases"), "command", told.alias("flags"))


def state_or_fresh(bodies: DataFrame, body: str, schema: str, fresh: dict[str, Column]) -> DataFrame:
    """``bodies`` with the state's fields and readable: what isn't a JSON object gives the fresh state."""
    readable = F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False))
    rows = bodies.withColumns({"readable": readable, "_state": F.from_json(body, schema)})
    fields = [F.when(F.col("readable"), F.col(f"_state.{name}")).otherwise(default).alias(name) for name, default in fresh.items()]
    return rows.select(*(c for c in bodies.columns if c != body), "readable", *fields)


def checked_lines(lines: DataFrame, line: str, number: str, schema: str, required: Sequence[str]) -> DataFrame:
    """``lines`` with their JSON fields and error: what is wrong, and with which line; blank lines and comments go."""
    rows = lines.where(~F.trim(line).rlike("^(#|$)")).withColumn("_v", F.try_parse_json(line))
    rows = rows.withColumn("_row", F.from_json(line, schema))
    said = lambda what: F.concat(F.lit("line "), F.col(number).cast("string"), F.lit(what))
    missing = [F.when(F.col(f"_row.{c}").isNull(), said(f": {c} is missing")) for c in required]
    kind = F.when(F.col("_v").isNull(), said(": not JSON")).when(~F.schema_of_variant("_v").startswith("OBJECT"), said(": not an object"))
    return rows.withColumn("error", F.coalesce(kind, *missing)).select(*(c for c in lines.columns if c != line), "_row.*", "error")


def one_or_many(body: str, field: str) -> Column:
    """A JSON field that is a string or a list of them, as an array; null where it is neither."""
    many = F.from_json(F.get_json_object(body, f"$.{field}"), "array<string>")
    one = F.get_json_object(body, f"$.{field}")
    return F.when(one.startswith("["), many).when(one.isNotNull(), F.array(one))


def registry_entries(files: DataFrame, text: str, keys: Sequence[str], required: Sequence[str], most_chars: int = 1 << 20, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, place, ``keys``, error) of each entry in strict YAML lists of flat entries

        - key: value
          key: "value"

    Only ``keys`` may occur, once each, and ``required`` ones must; comments and blank lines go. A text
    over ``most_chars`` is one row without an entry that says so.
    """
    lines = F.filter(F.split(text, "\r?\n"), lambda x: ~x.rlike(r"^\s*(#.*)?$"))
    body = F.array_join(lines, "\n")
    large = F.length(text) > most_chars
    blocks = F.filter(F.split(body, "(?m)^- "), lambda x: F.trim(x) != "")
    rows = files.select(*keep, large.alias("_large"), F.posexplode_outer(F.when(~large, blocks)).alias("place", "_block"))
    pairs = F.filter(F.split("_block", "\n"), lambda x: x != "")
    shape = r"^(?:  )?([a-z_]+): *\"?([^\"]*)\"?$"
    told = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, shape, 1).alias("key"), F.regexp_extract(x, shape, 2).alias("value")))
    rows = rows.withColumn("_told", F.coalesce(told, F.array().cast("array<struct<key:string,value:string>>")))
    value = lambda k: F.get(F.filter("_told", lambda x: x["key"] == k), F.lit(0))["value"]
    names = F.transform("_told", lambda x: x["key"])
    strange = F.get(F.filter(names, lambda k: (k != "") & ~k.isin(*keys)), F.lit(0))
    error = (
        F.when(F.col("_large"), "too large")
        .when(F.array_contains(names, ""), "malformed")
        .when(strange.isNotNull(), F.concat(F.lit("unknown key "), strange))
        .when(F.size(F.array_distinct(names)) < F.size(names), "a key comes twice")
    )
    missing = [F.when(value(k).isNull(), f"{k} is missing") for k in required]
    return rows.select(*keep, "place", *(value(k).alias(k) for k in keys), F.coalesce(error, *missing).alias("error"))
