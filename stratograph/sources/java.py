"""Declarations of Java source files as columns: tokens in rows, brackets by running sums, declarations by neighbouring tokens.

A file's tokens are dealt to one task by a single exchange; all that follows are windows over them:

1. ``_nested``: how deep each token lies, the bracket that it lies in, and brackets that don't match.
2. ``_statements``: within a bracket, annotations, and statements (up to a semicolon or a block).
3. ``_bodies``: which braces are bodies of types: of a declaration, an anonymous class, a constant of an enum.
4. ``_pieces``: statements of bodies are fields, methods or constructors; variables and parameters are parts of a statement or of a
   parameter list, cut at commas outside of ``<...>``.
5. ``extract``: a row for each file.

Bodies of methods count for the local and anonymous classes in them, whose fields and parameters are the file's too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Comments, texts, strings, characters, names, numbers, signs. Repeats are possessive, so a long one is no recursion.
TOKEN = (
    r'//[^\n]*+|/\*(?s:.*?)\*/|"""[^"\\]*+(?:(?s:\\.|"(?!""))[^"\\]*+)*+"""|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
    r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|[\p{L}_$][\p{L}\p{N}_$]*+|\p{N}[\p{L}\p{N}_.]*+|\.\.\.|->|::|@interface\b|\S"
)
NAME = r"^[\p{L}_$]"
MODIFIERS = ("public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed", "non-sealed")
OPEN, CLOSE = ("(", "{", "["), (")", "}", "]")
FILE = ("project_id", "file_seq")
SCHEMA = (
    "project_id string, file_seq long, class_name string, package_name string, is_interface boolean, super_class string, interfaces array<string>, "
    "annotations array<string>, imports array<string>, fields array<string>, methods array<string>, source_file string, field_types array<string>, "
    "constructor_types array<string>, parameter_types array<string>, error string"
)


def _over(*by: str, end: int = Window.currentRow) -> WindowSpec:
    """Rows of a file (and of ``by``) up to this one, in the order of tokens."""
    return Window.partitionBy(*FILE, *by).orderBy("pos").rowsBetween(Window.unboundedPreceding, end)


def _before(*by: str) -> WindowSpec:
    return _over(*by, end=-1)


def _all(*by: str) -> WindowSpec:
    return Window.partitionBy(*FILE, *by)


def _last(value: Column, where: Column, window: WindowSpec) -> Column:
    return F.last(F.when(where, value), ignorenulls=True).over(window)


def _place(where: Column, window: WindowSpec) -> Column:
    """The last place where something holds; -1 without one."""
    return F.coalesce(F.max(F.when(where, F.col("pos"))).over(window), F.lit(-1))


def tokens(content: Column) -> Column:
    """The tokens of a file as an array, without comments."""
    return F.filter(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: ~t.startswith("//") & ~t.startswith("/*"))


def _token_rows(files: DataFrame) -> DataFrame:
    """project_id, file_seq, pos, tok, and an empty token at a file's end."""
    return files.select(*FILE, F.posexplode(F.concat("tokens", F.array(F.lit("")))).alias("pos", "tok"))


def _nested(toks: DataFrame) -> DataFrame:
    """Rows (role, level, parent): a token as a child (c) of the bracket at place ``parent``; a bracket as the begin (o) and the end (x)
    of its own level; ``fault`` tells of brackets that don't match."""
    tok = F.col("tok")
    opens, closes = tok.isin(*OPEN), tok.isin(*CLOSE)
    deep = toks.withColumn("deep", F.sum(opens.cast("int") - closes.cast("int")).over(_over()))
    row = lambda role, level: F.struct(F.lit(role).alias("role"), level.alias("level"))
    roles = F.when(opens, F.array(row("c", F.col("deep") - 1), row("o", F.col("deep")))).when(closes, F.array(row("x", F.col("deep") + 1))).otherwise(F.array(row("c", F.col("deep"))))
    rows = deep.select(*FILE, "pos", "tok", F.explode(roles).alias("r")).select(*FILE, "pos", "tok", "r.*")
    opener = F.col("role") == "o"
    rows = rows.withColumns({"parent": _place(opener, _over("level")), "within": F.coalesce(_last(tok, opener, _over("level")), F.lit(""))})
    fits = F.coalesce(*(F.when(F.col("within") == a, tok == b) for a, b in zip(OPEN, CLOSE)), F.lit(False))
    wrong = F.when((F.col("role") == "x") & ~fits, F.concat(F.lit("unbalanced "), tok)).when((tok == "") & (F.col("level") > 0), F.concat(F.lit("unclosed "), F.col("within")))
    return rows.withColumn("fault", wrong).drop("level", "within")


def _statements(rows: DataFrame) -> DataFrame:
    """Adds what is told by neighbours within a bracket: annotations, declaring words, the place where the statement begins."""
    tok, child, over, before = F.col("tok"), F.col("role") == "c", _over("parent"), _before("parent")
    beside = Window.partitionBy(*FILE, "parent").orderBy("pos")
    previous = F.when(F.lag("role").over(beside) == "c", F.lag("tok").over(beside)).otherwise(F.lit(""))  # not the bracket itself
    rows = rows.withColumns({
        "prev": previous, "next": F.lead("tok").over(beside), "next2": F.lead("tok", 2).over(beside),
        "semicolon": _place(child & (tok == ";"), before), "equals": _place(child & (tok == "="), before),
    })
    chained = (tok == ".") | F.col("prev").isin(".", "@")
    rows = rows.withColumn("ends", child & ((tok == ";") | (tok == "{") & (F.col("equals") <= F.col("semicolon"))))
    rows = rows.withColumns({"chain": _place(~chained, over), "head": _last(tok, ~chained, over), "begin": _place(F.col("ends"), before)})
    rows = rows.withColumn("noted", child & (F.col("head") == "@"))
    named = child & ~F.col("noted") & F.coalesce(F.col("next").rlike(NAME), F.lit(False))
    declares = named & (tok.isin("class", "interface", "enum") & ~F.col("prev").isin(".", "::") | (tok == "@interface") | (tok == "record") & F.col("next2").isin("(", "<"))
    rows = rows.withColumn("declares", F.coalesce(declares, F.lit(False)))
    return rows.withColumns({
        "note_list": child & (tok == "(") & F.coalesce(F.lag("noted").over(beside), F.lit(False)),
        "declared": _place(F.col("declares"), over), "kind": _last(tok, F.col("declares"), over), "type": _last(F.col("next"), F.col("declares"), over),
    }).drop("head", "next2")


def _within(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Adds to all tokens of a bracket what the bracket itself is given. Its row as a child comes right before its row as a begin,
    which is the first of its own level."""
    both = Window.partitionBy(*FILE).orderBy("pos", "role")
    rows = rows.withColumns({f"_{name}": value for name, value in values.items()})
    rows = rows.withColumns({f"_{name}": F.when(F.col("role") == "o", F.lag(f"_{name}").over(both)) for name in values})
    return rows.withColumns({name: F.first(f"_{name}").over(_over("parent")) for name in values}).drop(*(f"_{name}" for name in values))


def _bodies(rows: DataFrame) -> DataFrame:
    """Adds to each token the body that it lies in directly: ``body`` (its kind; null if it isn't one), its type, and where that is
    declared. Keeps only what lies in bodies, headers and what may be parameters of a method."""
    tok, child = F.col("tok"), F.col("role") == "c"
    beside, before = Window.partitionBy(*FILE, "parent").orderBy("pos"), _before("parent")
    of_type = tok.rlike(NAME) & ~tok.isin("return", "throw", "else", "case", "instanceof") | tok.isin(".", "<", ">", ",", "?", "&", "@") | F.col("noted") | F.col("note_list")
    rows = rows.withColumn("made", child & (tok == "(") & (_place(child & (tok == "new"), before) > _place(child & ~of_type, before)))
    rows = rows.withColumn("made", F.coalesce(F.lag("made").over(beside), F.lit(False)))
    brace = child & (tok == "{")
    declared = brace & (F.col("declared") > F.col("begin"))
    kind = F.when(declared, F.col("kind")).when(brace & F.col("made"), F.lit("anonymous"))
    rows = _within(rows, {"body": kind, "body_at": F.when(declared, F.col("declared")), "body_type": F.when(declared, F.col("type"))})
    # braces among the constants of an enum are bodies, too; in a body, parentheses may hold parameters
    constant = (F.col("body") == "enum") & (F.col("semicolon") < 0)
    rows = rows.withColumn("constant", F.coalesce(constant, F.lit(False)))
    more = F.when(F.col("constant"), F.when(brace & ~declared, F.lit("constant"))).when(child & (tok == "(") & F.col("body").isNotNull(), F.lit("("))
    rows = _within(rows, {"more": more})
    # what lies in a constant's body is looked at once it is known as one
    rows = rows.withColumn("body", F.coalesce("body", F.when(F.col("more") == "constant", F.col("more"))))
    nested = F.when(child & (tok == "(") & (F.col("body") == "constant"), F.lit("("))
    rows = _within(rows, {"deeper": nested}).withColumn("more", F.coalesce("more", "deeper"))
    of_header = (F.col("declared") > F.col("begin")) | F.col("noted")
    return rows.filter(F.col("body").isNotNull() | F.col("more").isNotNull() | (F.col("parent") < 0) | of_header | (tok == "") | F.col("fault").isNotNull() | (F.col("role") == "o"))


def _marked(rows: DataFrame) -> DataFrame:
    """Adds, within a statement, how deep in ``<...>`` a token is, the part between commas, and lists of parameters."""
    by, tok, child = ("parent", "begin"), F.col("tok"), F.col("role") == "c"
    plain = child & ~F.col("noted") & ~F.col("note_list")
    modifier = tok.isin(*MODIFIERS) & ~F.coalesce(F.col("next").isin("=", ";", ",", ".", "("), F.lit(False)) | (tok == "non") & (F.col("next") == "-") | (tok == "-") & (F.col("prev") == "non")
    rows = rows.withColumn("plain", plain & ~modifier)
    # in an initializer "<" opens a list of types only behind a dot or the name of a type
    generic = (tok == "<") & ((F.col("equals") <= F.col("begin")) | (F.col("prev") == ".") | F.col("prev").rlike(r"^\p{Lu}"))
    step = F.when(plain & generic, 1).when(plain & (tok == ">"), -1).otherwise(0)
    in_body = F.col("body").isNotNull() & ~F.col("constant")
    list_ = plain & (tok == "(") & in_body & (F.col("equals") <= F.col("begin")) & (F.col("declared") <= F.col("begin")) & F.col("prev").rlike(NAME)
    rows = rows.withColumns({"walk": F.sum(step).over(_over(*by)), "list": list_ & (_place(list_, _before(*by)) <= F.col("begin"))})
    # a ">" that closes nothing doesn't count: the walk above its own least value so far
    rows = rows.withColumn("angle", F.col("walk") - F.least(F.lit(0), F.min("walk").over(_over(*by))))
    top = F.col("plain") & (F.col("angle") == 0)
    rows = rows.withColumns({
        "part": F.sum((top & (tok == ",") & (F.col("declared") <= F.col("begin"))).cast("int")).over(_over(*by)),
        "words": F.coalesce(F.sum((top & ~tok.isin(">", "[")).cast("int")).over(_before(*by)), F.lit(0)),
    })
    constructor = (F.col("prev") == F.col("body_type")) & (F.col("words") <= 1)
    rows = rows.withColumn("makes", F.when(F.col("list"), F.when(constructor, F.lit("CONSTRUCTOR")).otherwise(F.lit("METHOD_PARAMETER"))))
    return _within(rows, {"takes": F.col("makes")})


def _written(toks: Column) -> Column:
    """Tokens of a type as they are printed."""
    spaced = F.regexp_replace(F.array_join(toks, " "), " (extends|super|&) ", "\u0001$1\u0001")
    return F.translate(F.replace(F.replace(spaced, F.lit(" , "), F.lit(",\u0001")), F.lit(" "), F.lit("")), "\u0001", " ")


def _printed(text: Column) -> Column:
    """Tokens between spaces as source text."""
    closer = F.regexp_replace(text, r" (?=[.,;)\]>])|(?<=[\p{L}\p{N}_$>\]]) (?=[(\[<])", "")
    return F.regexp_replace(closer, r"(?<=[.@(\[<]) ", "")


def _listed(value: Column, order: Column, where: Column) -> Column:
    """An aggregate: values in the order of tokens."""
    rows = F.array_sort(F.collect_list(F.when(where & value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.transform(rows, lambda r: r["v"])


def _pieces(rows: DataFrame) -> DataFrame:
    """Parts of statements and of parameter lists: their plain tokens, and what the statement is."""
    tok, child = F.col("tok"), F.col("role") == "c"
    kept = F.when(F.col("plain") & ~(F.col("ends") | (tok == "") | (tok == ",") & (F.col("angle") == 0)), F.struct("pos", "tok"))
    heads = F.when(F.col("plain") & ~F.col("ends") & (F.col("angle") == 0) & (tok != ">"), F.struct("pos", "tok"))
    listed = F.coalesce(F.col("more") == "(", F.lit(False)) & F.col("takes").isNull()  # parentheses that hold no parameters
    told = rows.filter((child & ~listed) | F.col("fault").isNotNull())
    names = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda r: r["tok"])
    grouped = told.groupBy(*FILE, "parent", "begin", "part").agg(
        F.min("pos").alias("at"), names(kept).alias("toks"), names(heads).alias("heads"), F.max("body").alias("body"), F.max("body_type").alias("body_type"), F.max("body_at").alias("body_at"), F.max("takes").alias("takes"),
        F.max(F.when(F.col("ends"), tok)).alias("end"), F.max(F.when(F.col("ends"), F.col("pos"))).alias("end_at"), F.max(F.when(F.col("declares"), F.col("pos"))).alias("declares_at"), F.max(F.when(F.col("declares"), tok)).alias("kind"),
        F.max(F.when(F.col("list"), F.col("prev"))).alias("method"), F.max("makes").alias("makes"), F.max("constant").alias("constant"), F.min(F.when(F.col("fault").isNotNull(), F.struct("pos", "fault"))).alias("bracket"),
        F.array_sort(F.collect_list(F.when(F.col("noted") & (tok != "@"), F.struct("chain", "pos", "tok")))).alias("notes"),
    )
    whole = _all("parent", "begin")
    of = {"end": "statement_end", "end_at": "statement_end_at", "declares_at": "statement_declares", "method": "statement_method"}
    grouped = grouped.withColumns({name: F.max(c).over(whole) for c, name in of.items()})
    first = F.min(F.when(F.col("kind").isin("class", "interface"), F.col("declares_at"))).over(_all())
    return grouped.withColumn("first_at", first).withColumn("own", F.coalesce(F.col("body_at") == F.col("first_at"), F.lit(False)))


def _variables(pieces: DataFrame) -> DataFrame:
    """Adds to parts of fields and parameters the written type, of ``T...`` the element type."""
    toks = F.col("toks")
    cut = F.array_position(toks, "=").cast("int")
    decl = F.when(cut > 0, F.slice(toks, 1, F.greatest(cut - 1, F.lit(0)))).otherwise(toks)
    pieces = pieces.withColumn("decl", decl)
    brackets = F.length(F.regexp_extract(F.array_join("decl", " "), r"((?: \[)*)$", 1)) / 2
    pieces = pieces.withColumn("dims", brackets.cast("int"))
    pieces = pieces.withColumn("lead", F.slice("decl", 1, F.greatest(F.size("decl") - F.col("dims") - 1, F.lit(0)))).withColumn("name", F.get("decl", F.size("decl") - F.col("dims") - 1))
    typed = F.filter("lead", lambda t: t != "...")
    typed = F.flatten(F.transform(typed, lambda t: F.when(t == "[", F.array(F.lit("["), F.lit("]"))).otherwise(F.array(t))))
    suffix = F.repeat(F.lit("[]"), F.col("dims"))
    is_field = F.col("body").isNotNull() & F.col("takes").isNull() & ~F.col("constant") & F.col("statement_declares").isNull() & F.col("statement_method").isNull() & F.coalesce(F.col("statement_end") == ";", F.lit(False))
    pieces = pieces.withColumn("is_field", is_field)
    own = F.when(F.size(typed) > 0, _written(typed))
    of_all = F.max(F.when(F.col("part") == 0, own)).over(_all("parent", "begin"))
    pieces = pieces.withColumn("base", F.when(F.col("is_field"), of_all).otherwise(own))
    return pieces.withColumn("written", F.when((F.col("name") != "this") | F.col("is_field"), F.concat("base", suffix)))


def _faults(pieces: DataFrame) -> Column:
    """What cannot be read in a part; null if nothing."""
    some, lead = F.size("toks") > 0, F.get("toks", F.lit(0))
    word = F.concat(F.lit("unexpected "), lead)
    top = (F.col("parent") < 0) & F.col("statement_declares").isNull() & some & ~(lead.isin("package", "import") & F.coalesce(F.col("statement_end") == ";", F.lit(False)))
    # two names side by side are no type
    odd = F.array_join("lead", " ").rlike(r"(?:^| )(?!extends |super )[\p{L}_$]\S* (?!extends |super )[\p{L}_$]")
    parameter = F.col("takes").isNotNull() & F.col("body").isNull()
    no_type = parameter & some & (F.col("base").isNull() | ~F.col("name").rlike(NAME) | odd)
    member = F.col("body").isNotNull() & ~F.col("constant") & F.col("statement_declares").isNull() & F.col("statement_method").isNull()
    compact = (F.size("toks") == 1) & (lead == F.col("body_type"))
    stray = member & some & (F.col("statement_end").isNull() | (F.col("statement_end") == "{") & ~compact | F.col("is_field") & (odd | F.col("base").isNull() | F.col("name").isNull() | ~F.coalesce(F.col("name").rlike(NAME), F.lit(False))))
    return F.when(top, word).when(no_type, F.lit("no parameter type")).when(stray, word)


def extract(sources: DataFrame) -> DataFrame:
    """A row of SCHEMA for each source file (project_id, file_seq, path, content); a file that cannot be read has only an error. A file
    without content has no class. Files are numbered uniquely within a project."""
    # a number is given, as few bytes of source are much work: adaptive execution would put them into few tasks
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = sources.select(*FILE, "path", "content").repartition(n, *FILE).select(*FILE, "path", tokens(F.col("content")).alias("tokens"))
    pieces = _variables(_pieces(_marked(_bodies(_statements(_nested(_token_rows(files)))))))
    pieces = pieces.withColumn("fault", _faults(pieces))
    dotted = lambda names: F.array_join(names, "")
    simple = lambda names: F.transform(F.split(F.array_join(names, " "), " , "), lambda t: F.substring_index(F.trim(t), " ", -1))
    lead, top, is_first = F.get("toks", F.lit(0)), F.col("parent") < 0, F.coalesce(F.col("statement_declares") == F.col("first_at"), F.lit(False))
    rest = F.slice("toks", F.when(F.get("toks", F.lit(1)) == "static", 3).otherwise(2), F.size("toks"))
    header = F.array_join("heads", " ")
    clause = lambda word, others: F.regexp_extract(header, rf" {word} (.*?)(?: (?:{others}) |$)", 1)
    listed = lambda text: F.filter(simple(F.split(text, " ")), lambda t: t != "")
    # annotations stand before the declaring word, a name in pieces of one chain
    notes = F.filter("notes", lambda t: t["pos"] < F.col("statement_declares"))
    chains = F.array_distinct(F.transform(notes, lambda t: t["chain"]))
    named = F.transform(chains, lambda c: dotted(F.transform(F.filter(notes, lambda t: t["chain"] == c), lambda t: t["tok"])))
    first = F.when(is_first & F.col("declares_at").isNotNull(), F.struct(
        F.get("heads", F.array_position("heads", F.col("kind")).cast("int")).alias("class_name"), (F.col("kind") == "interface").alias("is_interface"),
        listed(clause("extends", "implements|permits")).alias("extended"), listed(clause("implements", "permits")).alias("interfaces"),
    ))
    gathered = pieces.groupBy(*FILE).agg(
        F.max(F.when(top & (lead == "package"), dotted(rest))).alias("package"),
        _listed(F.regexp_replace(dotted(rest), r"\.\*$", ""), F.col("at"), top & (lead == "import")).alias("imports"),
        F.max(first).alias("first"), F.flatten(_listed(named, F.col("at"), is_first)).alias("annotations"),
        _listed(F.col("method"), F.col("at"), F.col("own") & (F.col("makes") == "METHOD_PARAMETER")).alias("methods"),
        _listed(F.col("written"), F.col("at"), F.col("is_field")).alias("field_types"),
        *(_listed(F.col("written"), F.col("at"), F.col("takes") == k).alias(c) for k, c in (("CONSTRUCTOR", "constructor_types"), ("METHOD_PARAMETER", "parameter_types"))),
        _listed(F.struct("at", "statement_end_at"), F.col("at"), F.col("own") & F.col("is_field") & (F.col("part") == 0)).alias("field_places"),
        F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("at"))).alias("error"),
        F.min("bracket").alias("bracket"),
    )
    all_ = files.withColumnRenamed("path", "source_file").join(gathered, list(FILE), "left")
    error = F.coalesce("bracket.fault", "error")
    texts = F.transform("field_places", lambda p: _printed(F.array_join(F.slice("tokens", p["at"] + 1, p["statement_end_at"] - p["at"] + 1), " ")))
    good, none = error.isNull(), F.array().cast("array<string>")
    some = lambda c: F.when(good, F.coalesce(c, none)).otherwise(none)
    has = F.col("first").isNotNull()
    own = lambda c: F.when(has, c).otherwise(none)
    return all_.select(
        *FILE, F.when(good, F.col("first.class_name")).alias("class_name"), F.when(good, F.coalesce("package", F.lit(""))).otherwise(F.lit("")).alias("package_name"),
        F.coalesce(F.when(good, F.col("first.is_interface")), F.lit(False)).alias("is_interface"), F.when(good, F.try_element_at("first.extended", F.lit(-1))).alias("super_class"),
        some(F.col("first.interfaces")).alias("interfaces"), some(own(F.col("annotations"))).alias("annotations"), some(own(F.col("imports"))).alias("imports"),
        some(texts).alias("fields"), some(F.col("methods")).alias("methods"), "source_file",
        some(F.col("field_types")).alias("field_types"), some(F.col("constructor_types")).alias("constructor_types"), some(F.col("parameter_types")).alias("parameter_types"), error.alias("error"),
    )


def parsed(extracted: DataFrame, whole_projects: bool = False) -> DataFrame:
    """Files that could be read; with ``whole_projects``, only of projects all of whose files could."""
    good = extracted.filter("error IS NULL")
    if whole_projects:
        bad = extracted.filter("error IS NOT NULL").select("project_id").distinct()
        good = good.join(bad, "project_id", "left_anti")
    return good
