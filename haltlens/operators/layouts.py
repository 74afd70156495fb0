"""Recorded runs in nested JSON layouts, read by built-in expressions: no Python worker, one exchange (by trajectory, to number steps).

A file is parsed as VARIANT, which tells what its values are; what must keep its order (the values of an object, an object that is quoted whole) is
read as text beside it. A file is exploded into its units (items, action steps with their nodes, events), of which columns make steps:

- ``items``: an object with a list ``trajectory`` of ``action``, ``observation`` and ``response``, which is thought and content;
- ``nodes``: an object with ``nodes``, each with ``thoughts``, an ``assistant_message`` and ``action_steps`` of ``action`` and ``observation``;
- ``attempt``: an object whose ``best_attempt`` names the one of its members that has the events under ``traj``;
- ``events``: a list of one object, whose members are events with ``author_name``.

``layout_of`` also tells role messages (``roles``), lists of texts (``lines``) and everything else (``text``), which ``parse`` reads.

An object without text or content, and the arguments of a call that no rule fits, are quoted as JSON with their own order of keys. Arguments that are text are read as JSON,
single quotes allowed; other literals stay text.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tools named for two of the layouts, where the file names none.
ITEM_TOOL, NODE_TOOL = "sweagent", "moatless"
#: What code points from 128 to 159 stand for in character references.
CP1252 = {i: bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160)}

_PARTS = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)|[^&]+|&"
#: Names of characters and what they stand for, as one text to look in.
_NAMES = "\x01" + "".join(f"{k}\x02{v}\x01" for k, v in html.entities.html5.items())
#: What was matched is not given back: else a text takes a frame of the stack for each of its characters.
_JSON_PARTS = r'"(?:[^"\\]++|\\.)*+"|[^"]+|"'


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID (a null), a type of numbers; NULL where there is nothing. It walks the whole value: of large ones ``_is_object`` and ``field`` tell as much as is needed."""
    return F.substring_index(F.schema_of_variant(v), "<", 1)


def _once(x: Column, f) -> Column:
    """``f`` of ``x``, which is computed once however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _is_object(raw: Column) -> Column:
    """Whether a text is a JSON object; only such as begin like one are parsed."""
    return F.coalesce(F.when(F.ltrim(raw).rlike(r"^\s*\{"), parsed(raw).isNotNull()), F.lit(False))


def parsed(raw: Column) -> Column:
    return F.try_parse_json(raw)


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def unescaped(text: Column) -> Column:
    """Character references as HTML 5 reads them: numbers, names, and the names that need no semicolon, the longest first."""
    names = F.lit(_NAMES)

    def number(p: Column) -> Column:
        digits = F.regexp_replace(p, r"^&#[xX]?|;$", "")
        n = F.when(F.length(F.regexp_replace(digits, "^0+", "")) > 8, F.lit(1 << 40)).otherwise(F.coalesce(F.when(p.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)), F.lit("0")).cast("long"))
        old = F.create_map(*[F.lit(x) for k, v in CP1252.items() for x in (k, v)])
        char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        bad = ((n >= 1) & (n <= 8)) | ((n >= 14) & (n <= 31)) | ((n >= 127) & (n <= 159)) | ((n >= 0xFDD0) & (n <= 0xFDEF)) | (n == 11) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        return F.when(n == 0, "�").when(n == 13, "\r").when((n >= 128) & (n <= 159), F.element_at(old, n.cast("int"))).when(((n >= 0xD800) & (n <= 0xDFFF)) | (n > 0x10FFFF), "�").when(bad, "").otherwise(char)

    def name(p: Column) -> Column:
        body = F.substring(p, 2, 40)
        entry = lambda i: F.concat(F.lit("\x01"), F.substring(body, F.lit(1), i), F.lit("\x02"))
        known = F.get(F.filter(F.sequence(F.length(body), F.lit(1), F.lit(-1)), lambda i: names.contains(entry(i))), F.lit(0))
        return F.coalesce(F.concat(F.substring_index(F.call_function("substring_index", names, entry(known), F.lit(-1)), "\x01", 1), F.substring(body, known + 1, F.lit(40))), p)

    def part(p: Column) -> Column:
        return F.when(~p.startswith("&") | (F.length(p) == 1), p).when(p.startswith("&#"), number(p)).otherwise(name(p))

    return F.when(text.contains("&"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0)), part), "")).otherwise(text)


def dumped(raw: Column, literal: bool = False) -> Column:
    """JSON text with a space after each comma and colon; ``literal``: as a Python literal."""

    def part(p: Column) -> Column:
        plain = F.replace(F.replace(p, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))
        if not literal:
            return F.when(p.startswith('"'), p).otherwise(plain)
        for a, b in (("true", "True"), ("false", "False"), ("null", "None")):
            plain = F.replace(plain, F.lit(a), F.lit(b))
        inner = F.substring(p, F.lit(2), F.length(p) - 2)
        return F.when(p.startswith('"') & ~inner.contains("'") & ~inner.contains("\\"), F.concat(F.lit("'"), inner, F.lit("'"))).when(p.startswith('"'), p).otherwise(plain)

    return F.array_join(F.transform(F.regexp_extract_all(raw, F.lit(_JSON_PARTS), F.lit(0)), part), "")


def _scalar(v: Column) -> Column:
    s = F.try_variant_get(v, "$", "string")
    return F.when(kind(v) == "BOOLEAN", F.initcap(s)).otherwise(s)


def _object(v: Column, raw: Column, depth: int) -> Column:
    members = F.from_json(raw, "map<string,string>")
    content = field(v, "content")
    inner = _said(content, F.try_element_at(members, F.lit("content")), depth - 1) if depth else F.to_json(content)
    return F.when(F.map_contains_key(members, "text"), F.coalesce(F.try_element_at(members, F.lit("text")), F.lit(""))).when(F.map_contains_key(members, "content"), inner).otherwise(dumped(raw))


def _list(raw: Column, depth: int) -> Column:
    item = lambda r: F.when(kind(parsed(r)) == "OBJECT", _object(parsed(r), r, depth - 1)).otherwise(F.coalesce(r, F.lit("None")))
    flat = lambda r: F.coalesce(F.try_variant_get(parsed(r), "$.text", "string"), r, F.lit("None"))
    return F.array_join(F.transform(F.from_json(raw, "array<string>"), item if depth else flat), "\n")


def _said(v: Column, raw: Column, depth: int) -> Column:
    """One value as text; content may hold lists again, ``depth`` times."""
    k = kind(v)
    return F.when(k == "STRING", F.try_variant_get(v, "$", "string")).when(k == "OBJECT", _object(v, raw, depth)).when(k == "ARRAY", _list(raw, depth)).when(k == "VOID", "").otherwise(_scalar(v))


def cut(text: Column, limit: int | None) -> Column:
    """``text``, marked where it goes on beyond ``limit``; whole if there is none."""
    return text if limit is None else F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n[TRUNCATED]"))).otherwise(text)


def cleaned(text: Column, limit: int | None) -> Column:
    """References decoded, NUL taken out, cut at ``limit``, if there is one."""
    return cut(F.replace(unescaped(text), F.lit("\x00"), F.lit("")), limit)


def truthy(v: Column) -> Column:
    """The value as text, NULL where it says nothing (absent, null, false, zero, empty)."""
    s = F.try_variant_get(v, "$", "string")
    return F.when(v.isNotNull(), F.when(kind(v) == "STRING", F.nullif(s, F.lit(""))).when(~s.isin("false", "0", "0.0", "[]", "{}"), F.when(kind(v) == "BOOLEAN", "True").otherwise(s)))


def _first(v: Column, *names: str) -> Column:
    return F.coalesce(*[_once(field(v, n), truthy) for n in names])


def _each(df: DataFrame, columns: tuple[str, ...], f, plain) -> DataFrame:
    """The columns under ``f``, which is planned once for all of them and only looks at values of which ``plain`` (in compiled code) does not tell by itself what ``f`` makes of them."""
    df = df.withColumns({f"_of_{c}": plain(F.col(c)) for c in columns})
    left = F.array(*[F.when(F.col(f"_of_{c}").isNull(), F.col(c)) for c in columns])
    df = df.withColumn("_each", F.when(F.greatest(*[F.col(f"_of_{c}").isNull() for c in columns]), F.transform(left, f)))
    return df.withColumns({c: F.coalesce(f"_of_{c}", F.get("_each", F.lit(i))) for i, c in enumerate(columns)}).drop("_each", *[f"_of_{c}" for c in columns])


def _plain_said(x: Column) -> Column:
    return F.when(x["v"].isNull(), "").when(F.schema_of_variant(x["v"]) == "STRING", F.try_variant_get(x["v"], "$", "string"))


def _plain_text(limit: int | None):
    short = lambda x: F.lit(True) if limit is None else F.length(x) <= limit
    return lambda x: F.when(~x.contains("&") & ~x.contains(F.lit("\x00")) & short(x), x)


def with_texts(df: DataFrame, name: str, call: str, limit: int | None, out: str, texts: tuple[str, ...]) -> DataFrame:
    """Values of ``texts`` (each with its text as ``v`` and ``r``) as clean texts; ``out``: a tool call as one command line, by the tool's name and what its arguments (``call``)
    hold. A column for each step, so that nothing is computed twice."""
    c = lambda x: F.col(f"_{x}")
    blank = F.lit("")
    df = df.withColumns({"_kind": kind(F.col(f"{call}.v")), "_inner": F.trim(F.try_variant_get(f"{call}.v", "$", "string"))})
    absent = c("kind").isNull() | (c("kind") == "VOID") | ((c("kind") == "STRING") & (c("inner") == ""))
    single = F.when(c("inner").rlike(r"^[{\[]"), F.try_parse_json(F.to_json(F.from_json("_inner", "map<string,string>"))))
    df = df.withColumns({"_args": F.when(absent, F.parse_json(F.lit("{}"))).when(c("kind") == "STRING", F.coalesce(F.try_parse_json("_inner"), single)).otherwise(F.col(f"{call}.v")), "_raw": F.when(absent, F.lit("{}")).when(c("kind") == "STRING", c("inner")).otherwise(F.col(f"{call}.r"))})
    # of an object the members are read, not what it says as a whole
    df = df.withColumn("_form", F.coalesce(kind(c("args")), blank))
    df = df.withColumn("_spoken", F.when(c("form") != "OBJECT", F.struct(F.coalesce("_args", F.to_variant_object(F.array("_inner"))).alias("v"), F.when(F.col("_args").isNull(), F.to_json(F.array("_inner"))).otherwise(F.col("_raw")).alias("r"))))
    df = _each(df, (*texts, "_spoken"), lambda x: F.coalesce(_said(x["v"], x["r"], 2), blank), _plain_said)
    df = _each(df, (*texts, "_spoken"), lambda x: cleaned(x, limit), _plain_text(limit))
    quoted = lambda x: x if limit is None else F.substring(x, 1, limit)
    said_of = lambda *names: F.trim(F.coalesce(_first(c("args"), *names), blank))
    df = df.withColumns({"_low": F.lower(F.trim(name)), "_command": said_of("command", "cmd", "input"), "_path": said_of("path", "file_path", "directory"), "_pattern": said_of("pattern", "searchTerm", "query"), "_include": said_of("include"), "_verb": said_of("action")})
    low, command, path = c("low"), c("command"), c("path")
    edited = F.concat_ws(" ", F.lit("str_replace_editor"), F.coalesce(F.nullif(command, blank), F.nullif(c("verb"), blank), F.lit("view")), F.nullif(path, blank))
    line = (
        F.when((c("form") != "OBJECT") & low.isin("bash", "execute_bash", "execute_command", "shell"), c("spoken"))
        .when(c("form") != "OBJECT", F.trim(F.concat_ws(" ", name, c("spoken"))))
        .when(low.rlike("bash|shell") | low.isin("execute", "execute_command"), F.when(command != "", command).otherwise(quoted(dumped(c("raw"), literal=True))))
        .when(low.contains("grep"), F.trim(F.concat_ws(" ", F.lit("grep -R"), c("pattern"), c("include"))))
        .when(low.rlike("list|read") & (path != ""), F.concat(F.lit("str_replace_editor view "), path))
        .when(low.rlike("edit|replace|string"), edited)
        .when(command != "", command)
        .otherwise(F.trim(F.concat_ws(" ", name, quoted(dumped(c("raw"))))))
    )
    return df.withColumn(out, line).drop(*[x for x in df.columns if x.startswith("_")])


def _leading(raws: Column) -> Column:
    """The items of a list of JSON texts up to the first that is no object."""
    none = F.array().cast("array<string>")

    def upto(r: Column) -> Column:
        bad = F.array_position(F.transform(r, _is_object), F.lit(False))
        return _once(bad, lambda at: F.when(at > 0, F.slice(r, F.lit(1), (at - 1).cast("int"))).otherwise(r))

    return _once(F.coalesce(raws, none), upto)


def _member(raw: Column, name: str, of: str = "string") -> Column:
    return F.from_json(raw, f"struct<`{name}`: {of}>")[name]


def _ordered_values(raw: Column) -> Column:
    """The members of an object, in the file's order."""
    return F.map_values(F.from_json(raw, "map<string,string>"))


def attempt_events(raw: Column) -> Column:
    return _ordered_values(_member(_chosen(raw), "traj"))


def _chosen(raw: Column) -> Column:
    return _once(F.from_json(raw, "map<string,string>"), lambda m: F.try_element_at(m, F.try_element_at(m, F.lit("best_attempt"))))


def layout_of(raw: Column) -> Column:
    """The layout of a file, by its outermost values; the first that fits."""
    return _once(F.struct(parsed(raw).alias("v"), raw.alias("r")), lambda x: _layout(x["v"], x["r"]))


def _layout(v: Column, raw: Column) -> Column:
    a_map = lambda v, at: F.try_variant_get(v, at, "map<string,variant>").isNotNull()
    a_list = lambda v, at: F.try_variant_get(v, at, "array<variant>").isNotNull()
    has = lambda v, n: field(v, n).isNotNull()  # noqa: E731  # of an object only
    single = F.from_json(raw, "array<map<string,string>>")
    authored = F.exists(F.map_values(F.get(single, F.lit(0))), lambda r: has(parsed(r), "author_name"))

    def of_list(items: Column) -> Column:
        some = F.size(items) > 0
        return (
            F.when((F.size(items) == 1) & a_map(v, "$[0]") & F.coalesce(authored, F.lit(False)), "events")
            .when(some & F.forall(items, lambda x: has(x, "role")), "roles")
            .when(some & F.forall(items, lambda x: F.coalesce(kind(x) == "STRING", F.lit(False))), "lines")
            .otherwise("text")
        )

    return (
        F.when(v.isNull(), "text")
        .when(a_list(v, "$.trajectory"), "items")
        .when(has(v, "nodes"), "nodes")
        .when(has(v, "best_attempt") & a_map(parsed(_chosen(raw)), "$.traj"), "attempt")
        .when(a_list(v, "$"), _once(F.try_variant_get(v, "$", "array<variant>"), of_list))
        .otherwise("text")
    )


NESTED = ("items", "nodes", "attempt", "events")


def _units(raw: Column) -> Column:
    """Of a file its units in order: JSON texts of an item, an event, or a node with one of its action steps."""
    alone = lambda raws: F.transform(raws, lambda r: F.struct(r.alias("unit"), F.lit(None).cast("string").alias("part")))
    of_node = lambda n: F.transform(_leading(_member(n, "action_steps", "array<string>")), lambda p: F.struct(n.alias("unit"), p.alias("part")))
    objects = lambda raws: F.filter(raws, _is_object)
    return (
        F.when(F.col("layout") == "items", alone(_leading(_member(raw, "trajectory", "array<string>"))))
        .when(F.col("layout") == "nodes", F.flatten(F.transform(_leading(_member(raw, "nodes", "array<string>")), of_node)))
        .when(F.col("layout") == "attempt", alone(objects(attempt_events(raw))))
        .when(F.col("layout") == "events", alone(objects(_ordered_values(F.get(F.from_json(raw, "array<string>"), F.lit(0))))))
    )


#: Members of units and of their parts that become texts.
_MEMBERS = {"unit": ("response", "thoughts", "observation", "message", "content", "output", "assistant_message", "action", "input_text", "input"), "part": ("observation", "action")}


def _members(raw: str) -> Column:
    """The text of each member that is read, by one pass."""
    return F.from_json(raw, ", ".join(f"`{n}` string" for n in _MEMBERS[raw]))


def _value(of: str, raw: str, *names: str, truth: bool = False) -> Column:
    """Of a unit the first member that is there (``truth``: that says something): its value and its text (of ``_members``)."""
    pair = lambda n: _once(field(F.col(of), n), lambda v: F.when((truthy(v) if truth else v).isNotNull(), F.struct(v.alias("v"), F.col(raw)[n].alias("r"))))
    return F.coalesce(*[pair(n) for n in names])


def steps(files: DataFrame, *, limit: int | None = None) -> DataFrame:
    """``files`` (traj_id, text, layout; of NESTED) to one row per step, every one, in the columns of ``parse.parsed``. Blank steps are dropped before numbering. Texts are whole, unless a caller sets a ``limit`` of characters."""
    is_item, is_node = F.col("layout") == "items", F.col("layout") == "nodes"
    by = lambda item, node, event: F.when(is_item, item).when(is_node, node).otherwise(event)
    none = F.lit(None)
    u = files.filter(F.col("layout").isin(*NESTED)).select(F.col("traj_id").cast("string").alias("traj_id"), "layout", F.posexplode(_units(F.col("text"))).alias("at", "u"))
    u = u.select("traj_id", "layout", "at", F.col("u.unit").alias("unit"), F.col("u.part").alias("part"))
    u = u.select("traj_id", "layout", "at", _members("unit").alias("unit"), _members("part").alias("part"), parsed(F.col("unit")).alias("uv"), parsed(F.col("part")).alias("pv"))
    # what each text is made of
    u = u.select(
        "traj_id", "layout", "at",
        by(_value("uv", "unit", "response"), _value("uv", "unit", "thoughts", truth=True), none).alias("thought"),
        by(_value("uv", "unit", "observation"), _value("pv", "part", "observation", truth=True), _value("uv", "unit", "message", "content", "output", truth=True)).alias("feedback"),
        by(_value("uv", "unit", "response"), _value("uv", "unit", "assistant_message"), none).alias("content"),
        by(_value("uv", "unit", "action"), _value("pv", "part", "action"), F.coalesce(_value("uv", "unit", "input_text"), _value("uv", "unit", "input"))).alias("act"),
        by(F.lit(ITEM_TOOL), F.coalesce(_first(field(F.col("pv"), "action"), "action_args_class", "name"), F.lit(NODE_TOOL)), F.coalesce(_first(F.col("uv"), "author_name", "name", "role"), F.lit("event"))).alias("name"),
    )
    inner = lambda c, n: F.when(is_node & (kind(F.col(f"{c}.v")) == "OBJECT"), F.struct(field(F.col(f"{c}.v"), n).alias("v"), _member(F.col(f"{c}.r"), n).alias("r"))).otherwise(F.col(c))
    u = u.withColumns({"thought": inner("thought", "text"), "feedback": inner("feedback", "message")})
    u = u.withColumns({"own": F.when(is_item, F.col("act")), "acts": truthy(F.col("act.v")).isNotNull()})
    u = u.withColumn("act", F.when(~is_item, F.col("act")))  # what an item did is a text, not a call
    u = with_texts(u, "name", "act", limit, "line", ("thought", "feedback", "content", "own"))
    u = u.withColumn("action", F.when(is_item, F.col("own")).otherwise(F.col("line"))).drop("own", "line", "act")
    # few bytes take long: as many partitions as are set, not the few that would do for the bytes
    u = u.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "traj_id")
    # thoughts of events wait for the next action
    event = ~is_item & ~is_node
    u = u.withColumn("thinks", event & F.lower("name").contains("thought") & ~F.col("acts"))
    order = W.partitionBy("traj_id").orderBy("at")
    u = u.withColumn("stretch", F.count_if(~F.col("thinks")).over(order.rowsBetween(W.unboundedPreceding, -1)))
    waited = F.array_join(F.collect_list(F.when(F.col("thinks"), F.col("feedback"))).over(W.partitionBy("traj_id", "stretch").orderBy("at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "\n")
    u = u.withColumn("thought", F.when(event, waited).otherwise(F.col("thought"))).filter(~F.col("thinks"))
    u = u.withColumn("action", F.when(event & (F.trim("action") == ""), F.col("name")).otherwise(F.col("action")))
    both = F.regexp_replace(F.concat("thought", F.lit("\n"), "action"), r"^\s+|\s+$", "")
    u = u.withColumn("content", F.when(event, both).when(is_node & (F.col("content") == ""), F.col("thought")).otherwise(F.col("content")))
    u = _each(u, ("thought", "action", "feedback", "content"), lambda x: cleaned(x, limit), _plain_text(limit))
    says = F.lit(False)
    for n in ("action", "feedback", "thought"):
        says = says | F.col(n).rlike(r"\S")
    u = u.filter(says).withColumn("step_idx", F.row_number().over(order))
    tool = F.when(is_node, F.element_at(F.split("name", r"\."), -1)).otherwise(F.col("name"))
    return u.select("traj_id", "step_idx", F.col("thought").alias("thought_text"), F.col("action").alias("action_text"), F.col("feedback").alias("feedback_text"), F.col("content").alias("assistant_content_text"), tool.alias("tool_name"))
