"""Call sites of HTTP clients whose urls are built from constants, and what belongs to them.

Calls, constants and functions come off the table of tokens (see ``tokens``, ``callgraph``): brackets are followed to any depth,
comments don't count, calls through a script's own functions are those of the client behind them, and what its functions return
takes the place of their calls. Everything after that is relational. Constants of a script form a map; an argument is a chain
of quoted parts, names and calls joined by ``+``, and a name without a constant stays as a placeholder. Keys of an object inside a
setting are followed ``DEPTH`` brackets deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions.matches import WORD_START, let, matches, once, one_of, record
from brindle.functions.urls import asset_type, is_request_url, joined_url, path_params, query_params, url_confidence, url_kind
from brindle.operators import callgraph
from brindle.operators.callgraph import VERBS
from brindle.operators.order import dealt, first_wins, worked_out
from brindle.operators.scan import auth_signals
from brindle.operators.tokens import QUOTED as _QUOTED
from brindle.operators.tokens import rendered

#: Brackets inside an argument's own that are followed.
DEPTH = 12


def _inside(depth: int, outer: str = "") -> str:
    """What stands in brackets, ``outer`` excepted; in it up to ``depth`` more levels of them."""
    body = ""
    for n in range(depth + 1):
        nested = r"|[({\[]" + body + r"[)}\]]" if n else ""
        body = r"(?:[^(){}\[\]\"'`" + (outer if n == depth else "") + "]++|" + _QUOTED + r"|[\"'`]" + nested + ")*+"
    return body


_ALL = _inside(DEPTH)
#: One argument, or one setting of an object.
_ITEM = _inside(DEPTH, ",")
_NESTED = r"[({\[]" + _inside(DEPTH - 1) + r"[)}\]]"
_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*+"
_NAMES = _NAME + r"(?:\." + _NAME + r")*+"
_PART = "(?:" + _QUOTED + "|" + _NAMES + r"(?:\(" + _inside(3) + r"\))?+|[0-9]++)"
_CHAIN = _PART + r"(?:\s*+\+\s*+" + _PART + r")*+"
#: A type between a name and its value, and what a default stands behind.
_TYPED, _DEFAULT = r"(?:\s*:\s*[A-Za-z_$][A-Za-z0-9_$<>\[\]|. ]*?)?", r"(?:[A-Za-z_$][A-Za-z0-9_$.]*\s*(?:\|\||\?\?)\s*)?"
_DECLARED = WORD_START + r"(?:const|let|var)\s+(" + _NAME + ")"
CONSTANT = _DECLARED + _TYPED + r"\s*=\s*" + _DEFAULT + "(" + _CHAIN + r")\s*(?:;|,|\r?\n|\z)"
#: Rounds in which constants are resolved in each other.
ROUNDS = 5
#: Tokens of a constant that may be a text; what is longer is an expression of another kind.
MOST_PARTS = 4096
_NO_NAMES = "array<string>"
_PARAM = "array<struct<name:string,location:string,source:string>>"


def value_of(chain: Column, names: Column) -> Column:
    """A chain of quoted parts, names and calls as one text; null if it is anything else."""
    held = lambda name: F.coalesce(F.try_element_at(names, name), F.concat(F.lit("${"), name, F.lit("}")))

    def filled(template: Column) -> Column:
        """A template with its names filled in."""
        pieces = F.regexp_extract_all(template, F.lit(r"\$\{[^{}]*\}|[^$]+|\$"), F.lit(0))
        return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\$\{\s*" + _NAMES + r"\s*\}\z"), held(F.trim(F.substring(p, F.lit(3), F.char_length(p) - 3)))).otherwise(p)), "")

    def one(p: Column) -> Column:
        bare = F.substring(p, F.lit(2), F.char_length(p) - 2)
        plain = F.when(F.contains(bare, F.lit("\\")), F.regexp_replace(bare, r"\\(.)", "$1")).otherwise(bare)
        return (F.when(p.rlike("^[\"']"), plain).when(F.startswith(p, F.lit("`")), F.when(F.contains(bare, F.lit("${")), filled(bare)).otherwise(plain))
                .when(p.rlike("^[0-9]"), p).otherwise(held(F.regexp_extract(p, "^(" + _NAMES + ")", 1))))

    parts = F.regexp_extract_all(chain, F.lit(_PART), F.lit(0))
    good = chain.rlike(r"\A\s*" + _CHAIN + r"\s*\z")
    return F.when(good, F.substring(F.array_join(F.transform(parts, one), ""), 1, 4096))


def with_constants(scripts: DataFrame, text: str = "content") -> DataFrame:
    """``names``: map of the script's constants; later definitions win, chains of constants are followed ``ROUNDS`` times."""
    content = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<k:string,v:string>>")
    found = F.coalesce(F.when(content.rlike(r"(?:const|let|var)\s"), matches(content, CONSTANT, offsets=False, k=1, v=2)), none)
    return named_texts(once(scripts, _pairs=found))


def named_texts(rows: DataFrame) -> DataFrame:
    """``rows`` with ``names`` instead of ``_pairs`` (an array of names and texts of expressions, in order)."""
    plain = r"\A(?:\"[^\"\\]*\"|'[^'\\]*')\z"
    literal = lambda p: record(k=p["k"], v=F.substring(p["v"], F.lit(2), F.char_length(p["v"]) - 2))
    numbered = F.transform("_pairs", lambda p, i: record(k=p["k"], at=-i, v=p["v"]))
    # in order of names, the last definition of each first
    last = let(F.array_sort(numbered), lambda x: F.filter(x, lambda p, i: (i == 0) | (p["k"] != F.get(x, i - 1)["k"])))
    rows = once(rows.withColumn("_n", last).drop("_pairs"), _pairs=F.transform("_n", lambda p: record(k=p["k"], v=p["v"]))).drop("_n")
    rows = once(rows, _known=F.transform(F.filter("_pairs", lambda p: p["v"].rlike(plain)), literal), _open=F.filter("_pairs", lambda p: ~p["v"].rlike(plain)))

    def again(acc: Column, _: Column) -> Column:
        resolved = F.transform(F.col("_open"), lambda p: record(k=p["k"], v=value_of(p["v"], acc)))
        resolved = F.filter(resolved, lambda p: p["v"].isNotNull() & ~p["v"].rlike(r"\A\$\{[^{}]*\}\z"))  # a name alone says nothing
        return F.map_from_entries(F.concat(F.col("_known"), resolved))

    turns = F.slice(F.sequence(F.lit(1), F.lit(ROUNDS)), F.lit(1), F.least(F.size("_open"), F.lit(ROUNDS)))
    return once(rows, names=F.aggregate(turns, F.map_from_entries("_known"), again)).drop("_pairs", "_known", "_open")


def _object(value: Column) -> Column:
    """What stands in the braces of a value that is an object; else null."""
    return F.nullif(F.regexp_extract(value, r"\A\s*\{\s*(" + _ALL + r")\}\s*\z", 1), F.lit(""))


def entries(settings: Column) -> Column:
    """Array of struct(key, value) of an object's own settings, in order; methods and spreads are none. Null for null."""
    item = r"(?:\A|\G,)\s*+(?:(?:(" + _NAME + r")|\"([^\"\r\n]*+)\"|'([^'\r\n]*+)'|([0-9]++))\s*+:)?+(" + _ITEM + ")"
    found = matches(settings, item, offsets=False, a=1, b=2, c=3, d=4, value=5)
    named = F.transform(found, lambda e: record(key=F.concat(e["a"], e["b"], e["c"], e["d"]), value=F.trim(e["value"])))
    short = F.transform(named, lambda e: F.when((e["key"] == "") & e["value"].rlike(r"\A" + _NAME + r"\z"), record(key=e["value"], value=e["value"])).otherwise(e))
    return F.filter(short, lambda e: e["key"] != "")


def _keys(value: Column) -> Column:
    """Keys of a value that is an object."""
    return F.coalesce(F.transform(entries(_object(value)), lambda e: e["key"]), F.array().cast(_NO_NAMES))


def written_keys(value: Column) -> Column:
    """Keys in a JSON text that a value spells from quoted parts, at its own level or in a call that serialises it."""
    call = F.regexp_extract(value, r"\A" + _NAMES + r"\.(?:stringify|parseForm|formSerialize)\((" + _ALL + r")\)\z", 1)
    spelled = F.regexp_replace(F.when(call != "", call).otherwise(value), "(" + _QUOTED + ")|" + _NESTED, "$1")
    parts = F.regexp_extract_all(F.when(~F.startswith(value, F.lit("{")), spelled), F.lit(_QUOTED), F.lit(0))
    text = F.regexp_replace(F.array_join(F.transform(parts, lambda p: F.substring(p, F.lit(2), F.char_length(p) - 2)), ""), r"\\(.)", "$1")
    return F.coalesce(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\"']([A-Za-z_$][A-Za-z0-9_$.-]*)[\"']\s*:"), F.lit(1))), F.array().cast(_NO_NAMES))


def value_name(value: Column) -> Column:
    """Name of a value that is a name or a call of one, as an array; empty for others."""
    name = F.regexp_extract(value, r"\A(?!(?:true|false|null|this)(?![A-Za-z0-9_$]))(" + _NAMES + r")(?:\(" + _ALL + r"\))?+\z", 1)
    shown = F.when(F.endswith(value, F.lit(")")), F.concat(name, F.lit("()"))).otherwise(name)
    return F.when(F.coalesce(name, F.lit("")) != "", F.array(shown)).otherwise(F.array().cast(_NO_NAMES))


def _params(names: Column, location: Column | str, source: str) -> Column:
    where = F.lit(location) if isinstance(location, str) else location
    return F.transform(F.coalesce(names, F.array().cast(_NO_NAMES)), lambda n: record(name=n, location=where, source=F.lit(source)))


def _body(value: Column, location: Column | str = "body") -> Column:
    return F.concat(_params(_keys(value), location, "object"), _params(written_keys(value), location, "json-string"), _params(value_name(value), location, "value"))


def _joined(parts: Column) -> Column:
    """An object of the properties in ``parts``, an array of terms; null without any."""
    some = F.filter(parts, lambda t: F.size(t) > 0)
    spread = F.flatten(F.transform(some, lambda t, i: F.when(i > 0, F.concat(F.array(F.lit(",")), t)).otherwise(t)))
    return F.when(F.size(some) > 0, F.concat(F.array(F.lit("{")), spread, F.array(F.lit("}"))))


def _forwarded(rows: DataFrame) -> DataFrame:
    """Calls of forwarders as those of the client: the arguments in its order, what goes to its settings as an object."""
    arg = lambda c: F.when(F.col(c).isNotNull(), F.get("args", F.col(c)))
    none = F.array().cast("array<string>")
    config, reads = arg("config_at"), F.col("method").isin("GET", "HEAD")
    own = F.when((F.get(config, F.lit(0)) == "{") & (F.get(config, F.size(config) - 1) == "}"), F.slice(config, F.lit(2), F.size(config) - 2))
    keyed = lambda key, term: F.coalesce(F.concat(F.array(F.lit(key), F.lit(":")), term), none)
    settings = _joined(F.array(keyed("params", arg("query_at")), keyed("data", F.when(reads, arg("body_at"))), F.coalesce(own, none)))
    args = F.when(reads, F.array(arg("url_at"), settings)).otherwise(F.array(arg("url_at"), F.coalesce(arg("body_at"), none), settings))
    ahead = F.col("family") == "forward"
    return rows.withColumns({"args": F.when(ahead, args).otherwise(F.col("args")), "member": F.when(ahead, F.lower("method")).otherwise(F.col("member")), "family": F.when(ahead, "verb").otherwise(F.col("family"))})


def script_facts(scripts: DataFrame, text: str = "content") -> DataFrame:
    """What the tokens of each script say (see ``callgraph.facts``). Types of calls (``get<Row>(``) are left out."""
    return callgraph.facts(_untyped(scripts, text), "_t")


def file_and_base_facts(scripts: DataFrame, text: str = "content") -> DataFrame:
    """Those of ``script_facts`` that tables of chunks, base urls and counts of errors are made from, worked out once."""
    return worked_out(callgraph.file_and_base_facts(_untyped(scripts, text), "_t").select("script_id", F.inline("facts")))


def _untyped(scripts: DataFrame, text: str) -> DataFrame:
    """script_id and ``_t``, the text without types of calls."""
    content = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?<=[A-Za-z0-9_$])<[^<>()\"'`;]*+>(?=\()", "")
    return scripts.select("script_id", content.alias("_t"))


def bracket_errors(facts: DataFrame) -> DataFrame:
    """script_id, error_count: scripts some of whose brackets have no partner."""
    return facts.filter("kind = 'errors' and k > 0").select("script_id", F.col("k").alias("error_count"))


#: What a script has that calls a client at all.
_ASKS = r"fetch|axios|XMLHttpRequest|\$\s*\.|jQuery|\)\s*\(\s*\{"


#: Characters of scripts whose calls are worked out in their own rows. In longer ones what is looked up meets by joins, since
#: lookups in a row take as long as it has functions, each.
SHORT = 32_768


def _calls(scripts: DataFrame, text: str) -> DataFrame:
    """script_id, ord, object, source, member, family, names, the arguments a1 to a3 as texts and the settings (a term) of the calls of clients."""
    long = F.coalesce(F.char_length(F.col(text)) > SHORT, F.lit(False))
    short = _calls_in_rows(_untyped(scripts.filter(~long & F.col(text).rlike(_ASKS)), text))
    longer = scripts.filter(long)
    if longer.select(F.lit(1)).limit(1).count() == 0:
        return short
    return short.unionByName(_calls_by_joins(worked_out(callgraph.facts(_untyped(longer.filter(F.col(text).rlike(_ASKS)), text), "_t"))))


def _client_calls(rows: DataFrame) -> DataFrame:
    """Those of ``rows`` (name, member, args, target, form, _xhr and the places of a forwarder) that call a client, as the client gets them."""
    name, member = F.col("name"), F.lower("member")
    client, jquery = (name == "axios") | F.col("target").isNotNull(), name.isin("$", "jQuery")
    family = (F.when(F.col("member").isNull(), "config").when(member == "", F.when(name == "fetch", "fetch").when(F.col("form") == "config", "config").when(F.col("form") == "method", "forward").when((name == "axios") | (F.col("target") == "axios"), "config"))
              .when(jquery & (member == "ajax"), "ajax").when(jquery & member.isin("get", "post"), "verb").when(client & member.isin(*VERBS), "verb")
              .when(client & (member == "request"), "config").when(F.col("_xhr") & (member == "open"), "open").when(F.col("_xhr") & (member == "setrequestheader"), "header"))
    source = F.when(F.coalesce(F.col("member"), F.lit("")) == "", name).otherwise(F.concat_ws(".", name, "member"))
    return _forwarded(rows.withColumns({"family": family, "source": source}).filter("family is not null and args is not null"))


def _kept(rows: DataFrame, *more: Column | str) -> DataFrame:
    return rows.select("script_id", F.col("pos").alias("ord"), F.col("name").alias("object"), "source", F.coalesce("member", F.lit("")).alias("member"), "family", *more)


def _calls_in_rows(scripts: DataFrame) -> DataFrame:
    """The calls of scripts each of which is worked out in its row, without a shuffle."""
    of = lambda kind: F.filter("facts", lambda f: f["kind"] == kind)
    made = F.transform(F.filter("facts", lambda f: (f["kind"] == "made") & (F.get(f["term"], F.lit(1)) == "XMLHttpRequest")), lambda f: f["name"])
    rows = once(callgraph.fact_lists(scripts, "_t", callgraph.CALL_KINDS), _own=of("call"), _functions=of("function"), _returned=of("return"), _constants=of("constant"), _requests=made).drop("facts").filter(F.size("_own") > 0)
    rows = once(rows, _defined=callgraph.functions_in_row(F.col("_functions"), F.col("_returned"))).drop("_functions")
    rows = once(rows, _clients=callgraph.aliases_in_row(*map(F.col, ("_constants", "_returned", "_own", "_defined"))), _bodies=F.filter("_defined", lambda f: F.size(f["term"]) > 0))
    renewed = F.transform("_constants", lambda c: record(name=c["name"], term=callgraph.inlined_in_row(c["term"], F.col("_bodies"))))
    rows = once(rows, _ahead=callgraph.forwarders_in_row(*map(F.col, ("_defined", "_own", "_clients"))), _renewed=renewed).drop("_constants", "_returned", "_defined")
    texts = F.filter("_renewed", lambda c: (F.get(c["term"], F.lit(0)) != "{") & (F.size(c["term"]) < MOST_PARTS))
    rows = named_texts(once(rows, _pairs=F.transform(texts, lambda c: record(k=c["name"], v=_undefaulted(c["term"])))))

    def one(c: Column) -> Column:
        by = F.get(F.filter("_ahead", lambda a: a["name"] == c["name"]), F.lit(0))["by"]
        target = F.get(F.filter("_clients", lambda k: k["name"] == c["name"]), F.lit(0))["target"]
        return record(pos=c["pos"], name=c["name"], member=c["member"], args=c["args"], target=target, _by=by, _xhr=F.when(F.array_contains("_requests", c["name"]), True))

    rows = rows.select("script_id", "names", "_bodies", "_renewed", F.inline(F.transform(F.filter("_own", lambda c: c["args"].isNotNull()), one)))
    rows = _client_calls(rows.select("*", "_by.*").drop("_by"))
    args = F.transform(F.slice("args", F.lit(1), F.lit(3)), lambda t: callgraph.inlined_in_row(t, F.col("_bodies")))
    rows = once(_kept(rows, "names", "_bodies", "_renewed", "args"), _new=args).drop("args", "_bodies").withColumnRenamed("_new", "args")
    rows = once(rows, settings=_settings())
    held = F.get(F.reverse(F.filter("_renewed", lambda c: c["name"] == F.get("settings", F.lit(0)))), F.lit(0))["term"]
    is_object = (F.get(held, F.lit(0)) == "{") & (F.get(held, F.size(held) - 1) == "}")
    rows = once(rows, _set=F.when((F.size("settings") == 1) & is_object, held).otherwise(F.col("settings"))).drop("settings", "_renewed").withColumnRenamed("_set", "settings")
    return _told(rows)


def _undefaulted(term: Column) -> Column:
    return F.regexp_replace(rendered(term), r"\A" + _DEFAULT, "")


def _settings() -> Column:
    """The argument of a call that holds its settings."""
    reads = F.upper("member").isin("GET", "HEAD")
    at = F.when(F.col("family").isin("ajax", "config"), 0).when((F.col("family") == "fetch") | reads, 1).when(F.col("family") == "verb", 2)
    return F.get("args", at)


def _told(rows: DataFrame) -> DataFrame:
    text_of = lambda n: F.coalesce(rendered(F.get("args", F.lit(n))), F.lit(""))
    return rows.select("script_id", "ord", "names", "object", "source", "member", "family", "settings", *(text_of(n).alias(f"a{n + 1}") for n in range(3)))


def _calls_by_joins(found: DataFrame) -> DataFrame:
    """The calls of scripts whose facts are ``found``, which may be many in each."""
    own = worked_out(found.filter("kind = 'call'").select("script_id", "pos", "name", "member", "start", "close", "args"))
    defined = worked_out(callgraph.functions(found))
    known = callgraph.aliases(found, own, defined)
    ahead = callgraph.forwarders(defined, own, known)
    xhr = found.filter((F.col("kind") == "made") & (F.get("term", F.lit(1)) == "XMLHttpRequest")).select("script_id", "name", F.lit(True).alias("_xhr")).distinct()
    rows = _client_calls(own.join(known, ["script_id", "name"], "left").join(ahead, ["script_id", "name"], "left").join(xhr, ["script_id", "name"], "left"))
    rows = worked_out(_kept(rows, F.slice("args", F.lit(1), F.lit(3)).alias("args")))
    # arguments and constants in which functions of the script may be called
    calls_in = lambda t: F.exists(t, lambda x: x == "(")
    constants = found.filter("kind = 'constant'").select("script_id", F.col("pos").alias("ord"), "name", "term")
    terms = rows.select("script_id", "ord", F.posexplode("args").alias("n", "term")).unionByName(constants.select("script_id", "ord", F.lit(-1).alias("n"), "term"))
    made = callgraph.inlined(terms.filter(calls_in("term")).select("script_id", (F.col("ord").cast("long") * 4 + F.col("n") + 1).alias("key"), "term"), defined)
    made = worked_out(made.select("script_id", F.floor(F.col("key") / 4).cast("int").alias("ord"), (F.col("key") % 4 - 1).cast("int").alias("n"), "term"))
    built = made.filter("n >= 0").groupBy("script_id", "ord").agg(F.collect_list(F.struct("n", "term")).alias("_made"))
    fresh = lambda t, i: F.coalesce(F.get(F.filter("_made", lambda m: m["n"] == i), F.lit(0))["term"], t)
    rows = rows.join(built, ["script_id", "ord"], "left").withColumn("args", F.transform("args", fresh)).drop("_made")
    constants = constants.join(made.filter("n = -1").select("script_id", "ord", F.col("term").alias("_new")), ["script_id", "ord"], "left").withColumn("term", F.coalesce("_new", "term")).drop("_new")
    objects = constants.groupBy("script_id", "name").agg(F.max_by("term", "ord").alias("_object")).filter((F.get("_object", F.lit(0)) == "{") & (F.get("_object", F.size("_object") - 1) == "}"))
    last = _undefaulted(F.col("term"))
    pairs = constants.filter((F.get("term", F.lit(0)) != "{") & (F.size("term") < MOST_PARTS)).groupBy("script_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("name").alias("k"), last.alias("v")))).alias("_x"))
    names = named_texts(pairs.select("script_id", F.transform("_x", lambda x: record(k=x["k"], v=x["v"])).alias("_pairs")))
    rows = rows.withColumn("settings", _settings())
    held = F.when(F.size("settings") == 1, F.get("settings", F.lit(0)))
    rows = rows.withColumn("_held", held).join(objects.withColumnRenamed("name", "_held"), ["script_id", "_held"], "left").withColumn("settings", F.coalesce("_object", "settings")).drop("_held", "_object")
    return _told(rows.join(names, "script_id", "left"))


def client_calls(scripts: DataFrame, text: str = "content") -> DataFrame:
    """script_id, ord, source, method, url, kind, confidence, params (name, location, source), headers and auth (signals):
    calls of fetch, jQuery, axios and its aliases, and opens of request objects; the first of each method, url and source
    stays."""
    rows = _calls(scripts, text)
    family = F.col("family")
    reads = F.upper("member").isin("GET", "HEAD")
    rows = once(rows, _e=callgraph.entries(F.col("settings"))).drop("settings")
    hit = lambda *keys: F.get(F.reverse(F.filter("_e", lambda e: one_of(F.lower(e["key"]), *keys))), F.lit(0))["value"]
    exact = lambda key: F.get(F.reverse(F.filter("_e", lambda e: e["key"] == key)), F.lit(0))["value"]
    rows = once(
        rows,
        _url=F.when(family.isin("fetch", "verb", "header"), F.col("a1")).when(family == "open", F.col("a2")).when(F.col("_e").isNotNull(), exact("url")).when(family == "ajax", F.col("a1")),
        _how=F.when(family == "open", F.col("a1")).when(family == "ajax", hit("method", "type")).when(family == "config", exact("method")).when(family == "fetch", hit("method")),
        _query=hit("params", "query"), _data=hit("data", "body"), _named=hit("headers"), _sent=F.when((family == "verb") & ~reads, F.col("a2"))).drop("_e", "a1", "a2", "a3")
    quoted = (family != "fetch") | F.col("_how").rlike("^[\"']")
    rows = once(rows, url=value_of(F.col("_url"), F.col("names")), _method=F.when(quoted, value_of(F.col("_how"), F.col("names")))).drop("names", "_url", "_how")
    rows = rows.filter((family == "header") | is_request_url(F.col("url"), templates=True)).filter("url <> ''")
    default = F.when(family.isin("fetch", "ajax"), "GET")
    method = F.upper(F.when(family == "verb", F.col("member")).otherwise(F.coalesce("_method", default)))
    rows = once(rows, method=method, _set=_keys(F.col("_named")), _data_keys=_keys(F.col("_data")))
    spelled = F.when(family.isin("fetch", "verb", "open"), F.regexp_extract_all("url", F.lit(r"\$\{([A-Za-z0-9_$.]+)\}"), F.lit(1)))
    where = F.when(F.col("method") == "GET", "query").otherwise("body")
    params = F.concat(
        _params(path_params(F.col("url")), "path", "url"), _params(query_params(F.col("url")), "query", "url"), _params(spelled, "path", "expression"), _body(F.col("_sent")),
        _params(_keys(F.col("_query")), "query", "object"), _body(F.col("_data")), _params(F.col("_set"), "header", "object"),
        _params(F.when(family == "ajax", F.col("_data_keys")), where, "object"))
    rows = once(
        rows, params=F.when(family != "header", F.array_distinct(params)), headers=F.when(family != "header", F.col("_set")),
        _key=F.when(family.isin("open", "header"), F.col("object")), header=F.when(family == "header", F.col("url")), _open=F.when(family == "open", F.col("url")))
    rows = rows.select("script_id", "ord", "family", "source", "method", "url", "params", "headers", "_key", "header", "_open")
    rows = dealt(rows, "script_id")  # all that follows is within a script
    rows = _headers_upto(rows, ["script_id", "_key"], "_open", "_more").filter("family <> 'header'")
    late = F.when(F.col("family") == "open", F.col("_more")).otherwise(F.array().cast(_NO_NAMES))
    rows = rows.withColumn("headers", F.array_distinct(F.concat("headers", late)))
    rows = once(rows, kind=url_kind(F.col("url")), auth=auth_signals(F.col("headers"), F.col("url"), more=F.col("headers")))
    rows = rows.filter("kind = 'api'").withColumn("confidence", url_confidence(F.col("url"), F.col("kind")))
    return first_wins(rows, ["script_id", "method", "url", "source"], "ord").select("script_id", "ord", "source", "method", "url", "kind", "confidence", "params", "headers", "auth")


def call_params(calls: DataFrame) -> DataFrame:
    """script_id, api, name, location, source: a row for each parameter; the first of each location, api and name stays.

    Headers that are set on request objects belong to no api.
    """
    rows = calls.select("script_id", "ord", F.col("url").alias("api"), F.posexplode("params").alias("pos", "p")).select("script_id", "ord", "pos", "api", "p.*")
    opened = calls.filter(F.endswith("source", F.lit(".open")))
    setter = F.concat(F.substring_index("source", ".", 1), F.lit(".setRequestHeader"))
    rows = rows.unionByName(opened.select(
        "script_id", "ord", setter.alias("source"), F.posexplode("headers").alias("pos", "name")).select("*", F.lit(None).cast("string").alias("api"), F.lit("header").alias("location")))
    return first_wins(rows, ["script_id", "location", "api", "name"], ["ord", "pos"]).drop("ord", "pos")


def call_auth(calls: DataFrame) -> DataFrame:
    """script_id, auth: each signal of a script once, in the order of its calls."""
    rows = calls.select("script_id", "ord", F.posexplode("auth").alias("pos", "signal"))
    rows = rows.groupBy("script_id", "signal").agg(F.min(F.struct("ord", "pos")).alias("at"))
    return rows.groupBy("script_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "signal"))), lambda x: x["signal"]).alias("auth"))


def _headers_upto(events: DataFrame, keys: list[str], opened: str, name: str) -> DataFrame:
    """``name``: of each row that opens, the headers set before it and those set after it up to the next open, in order."""
    w = Window.partitionBy(*keys).orderBy("ord")
    rows = events.withColumn("_g", F.count(opened).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_before", F.collect_list("header").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*keys, "_g").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_own", F.collect_list("header").over(own))
    return rows.withColumn(name, F.array_distinct(F.concat("_before", "_own"))).drop("_g", "_before", "_own")


def headers_of_opens(events: DataFrame, keys: list[str]) -> DataFrame:
    """``headers`` of each open call of a request object, in order-sensitive (as-of) fashion, in the order in which they are set.

    ``events``: ``keys`` (script and object), ord, url (of an open, else null), header (else null). An open gets every
    header set before it, and those set after it up to the next open.
    """
    return _headers_upto(events, keys, "url", "headers").filter("url is not null").drop("header")


def xhr_events(scripts: DataFrame, text: str = "content") -> DataFrame:
    """script_id, object, ord, url, method, header: opens and headers of request objects, in page order."""
    rows = _calls(scripts, text).filter("family in ('open', 'header')")
    opened = F.col("family") == "open"
    rows = rows.select("script_id", "object", "ord", F.when(opened, value_of(F.col("a2"), F.col("names"))).alias("url"),
                       F.when(opened, F.upper(value_of(F.col("a1"), F.col("names")))).alias("method"), F.when(~opened, value_of(F.col("a1"), F.col("names"))).alias("header"))
    return rows.filter("url is not null or header is not null")


def with_base_url(apis: DataFrame, bases: DataFrame) -> DataFrame:
    """base_url, resolved_url, confidence and notes of relative urls by the first base url of their script."""
    first = bases.groupBy("script_id").agg(F.min_by("value", "ord").alias("base_url"))
    rows = apis.join(first, "script_id", "left")
    relative, rooted = ~F.col("url").rlike("(?i)^(?:https?:)?//"), F.startswith("url", F.lit("/"))
    based = relative & F.col("base_url").isNotNull()
    note = F.when(based, F.array(F.lit("resolved-from-static-base-url"))).when(
        relative & rooted, F.array(F.lit("relative-url-without-static-base-url"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({
        "resolved_url": F.when(based, joined_url(F.col("base_url"), F.col("url"))), "notes": note,
        "confidence": F.when(based, "high").otherwise(F.col("confidence")), "base_url": F.when(based, F.col("base_url"))})


def chunk_assets(scripts: DataFrame, text: str = "content") -> DataFrame:
    """script_id, url, type, chunk_name: files that a loader joins from quoted parts and a table of chunks.

    ``"a/" + e + "." + {"c1": "h1"}[e] + ".js"`` gives a/c1.h1.js for c1; without a name ahead of the table, a/h1.js.
    """
    q = r"[\"']([^\"'\r\n]*)[\"']"
    pattern = q + r"\s*\+\s*(?:([A-Za-z_$][A-Za-z0-9_$]*)\s*\+\s*" + q + r"\s*\+\s*)?\{([^{}]*)\}\s*\[\s*[A-Za-z_$][A-Za-z0-9_$]*\s*\]\s*\+\s*" + q
    found = matches(F.coalesce(F.col(text), F.lit("")), pattern, prefix=1, slot=2, infix=3, table=4, suffix=5)
    entry = r"[\"']?([A-Za-z0-9_$~./-]+)[\"']?\s*:\s*[\"']([^\"'\r\n]*)[\"']"
    rows = scripts.select("script_id", found.alias("_m")).select("script_id", F.posexplode("_m").alias("at", "m"))
    pairs = F.arrays_zip(F.regexp_extract_all("m.table", F.lit(entry), F.lit(1)).alias("k"), F.regexp_extract_all("m.table", F.lit(entry), F.lit(2)).alias("h"))
    rows = rows.select("script_id", "at", "m", F.posexplode(pairs).alias("pos", "e"))
    named = F.coalesce(F.col("m.slot"), F.lit("")) != ""
    url = F.concat("m.prefix", F.when(named, F.concat("e.k", F.coalesce("m.infix", F.lit("")))).otherwise(""), "e.h", "m.suffix")
    rows = rows.select("script_id", (F.col("at") * 100_000 + F.col("pos")).alias("ord"), url.alias("url"), F.col("e.k").alias("chunk_name"))
    shaped = F.col("url").rlike(r"(?i)\.(?:m?js|css)\z|(?:^|/)(?:assets?|static|chunks?)/")
    return first_wins(rows.filter(shaped).withColumn("type", asset_type(F.col("url"))), ["script_id", "type", "url", "chunk_name"], "ord")


__all__ = ["bracket_errors", "call_auth", "call_params", "chunk_assets", "client_calls", "entries", "file_and_base_facts", "headers_of_opens", "named_texts", "script_facts", "value_name", "value_of", "with_base_url", "with_constants", "written_keys", "xhr_events"]
