"""Column expressions of the architecture model. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _cascade(rules: Iterable[tuple[Column, str]]) -> Column:
    """The value of the first rule that holds; null if none does."""
    out = F
    for condition, value in rules:
        out = out.when(condition, F.lit(value))
    return out


def trim_java(value: Column) -> Column:
    """Trim as Java does: every character up to the space, control characters included."""
    # the most begin and end with more than a space, which their bytes tell, or have spaces alone about them; a trim of a list costs more
    bare = lambda v: (v >= "!") & (F.substring(v.cast("binary"), -1, 1) > F.lit(b" "))
    return F.when(bare(value), value).when(bare(F.trim(value)), F.trim(value)).otherwise(F.btrim(value, F.lit("".join(map(chr, range(0x21))))))


def is_blank(value: Column) -> Column:
    return value.rlike(r"^\s*$")


# roles of classes


def role_by_annotation(annotations: Column) -> Column:
    return _cascade((F.array_contains(annotations, name), role) for name, role in fixed.ANNOTATION_ROLES)


def role_by_superclass(super_class: Column) -> Column:
    return _cascade((super_class == name, role) for name, role in fixed.SUPERCLASS_ROLES.items())


def role_by_interface(interfaces: Column) -> Column:
    return _cascade((F.array_contains(interfaces, name), role) for name, role in fixed.INTERFACE_ROLES)


def role_by_name(class_name: Column, is_interface: Column) -> Column:
    of_class = _cascade((class_name.endswith(suffix), role) for suffix, role in fixed.SUFFIX_ROLES)
    return F.when(is_interface, F.when(class_name.endswith("Repository"), F.lit("REPOSITORY"))).otherwise(of_class)


def role_by_package(package_name: Column) -> Column:
    last = F.lower(F.substring_index(package_name, ".", -1))
    return _cascade((last == name, role) for name, role in fixed.PACKAGE_ROLES.items())


def component_type(class_name: Column, is_interface: Column, annotations: Column, super_class: Column, interfaces: Column, package_name: Column) -> Column:
    """Annotation, then superclass, interfaces, name and package; UNKNOWN if none tells, or if the file has no class."""
    found = F.coalesce(
        role_by_annotation(annotations), role_by_superclass(super_class), role_by_interface(interfaces), role_by_name(class_name, is_interface),
        role_by_package(package_name), F.lit("UNKNOWN"),
    )
    return F.when(class_name.isNull(), F.lit("UNKNOWN")).otherwise(found)


# type references


def normalize_type(raw: Column) -> Column:
    """The simple name that a written type refers to; only the outermost generic is opened.

    Null gives an empty string. A bounded wildcard whose bound ends before it begins (as in ``Map<List<A>, ? extends B>``) has
    no name: the result is null, which ``type_error`` tells from the rest.
    """
    return normalize_trimmed(trim_java(raw))


def normalize_trimmed(value: Column) -> Column:
    """``normalize_type`` of a type that is trimmed."""
    return normalize_part(value, name_part(value))


def name_part(value: Column) -> Column:
    """The part of a trimmed type that its name stands in; spaces about what was in brackets are still there."""
    begin, end = F.instr(value, F.lit("extends")) + 8, F.instr(value, F.lit(">"))
    bound = F.when((end > 0) & (begin <= end), F.substr(value, begin, end - begin))
    inner = F.substr(value, F.instr(value, F.lit("<")) + 1, F.length(value) - F.instr(F.reverse(value), F.lit(">")) - F.instr(value, F.lit("<")))
    return (
        F.when(value.isNull(), F.lit(""))
        .when(value.contains("? extends"), bound)
        .when(value.contains("<") & value.contains(">"), F.substring_index(inner, ",", -1))
        .otherwise(F.substring_index(value, ".", -1))
    )


def normalize_part(value: Column, part: Column) -> Column:
    """The name in the ``name_part`` of a trimmed type."""
    return F.when(value.contains("? extends") | (value.contains("<") & value.contains(">")), trim_java(part)).otherwise(part)


def type_error(raw: Column) -> Column:
    return normalize_type(raw).isNull()


def is_primitive(name: Column) -> Column:
    return name.isin(*fixed.PRIMITIVES)


def is_stop_listed(name: Column) -> Column:
    return name.isin(*fixed.IGNORED_TYPES)


def is_ignored(name: Column) -> Column:
    """Whether a normalized type name stays out of the graph."""
    plain = (F.length(name) > 3) & (name >= "!") & ~name.endswith("]")  # none of these, and a pattern costs more
    odd = F.when(plain, F.lit(False)).otherwise(name.rlike(r"^(\s*|[A-Z])$|\[\]\z"))  # blank, a single capital, an array
    return F.coalesce(name.isin(*fixed.PRIMITIVES, *fixed.IGNORED_TYPES) | odd, F.lit(True))


# names, folders, packages


def folder_type(component: Column) -> Column:
    return F.coalesce(_cascade((component == role, folder) for role, folder in fixed.ROLE_FOLDERS.items()), F.lit("COMMON"))


def folder_name(folder: Column) -> Column:
    return _cascade((folder == kind, name) for kind, name in fixed.FOLDER_NAMES.items())


def naming_heuristic(class_name: Column) -> Column:
    left = reduce(lambda value, part: F.replace(value, F.lit(part), F.lit("")), fixed.NAME_PARTS, class_name)
    return F.when(class_name.isNull() | is_blank(class_name) | is_blank(left), F.lit("common")).otherwise(F.lower(left))


def target_package(base: Column, module: Column, folder: Column) -> Column:
    """base.module.folder; without a base no leading dot, without a module ``common``, without a folder base and module as is."""
    blank = lambda c: c.isNull() | is_blank(c)
    named = F.when(blank(module), F.lit("common")).otherwise(F.lower(module))
    return F.when(folder.isNull(), F.concat(F.coalesce(base, F.lit("")), F.lit("."), F.coalesce(module, F.lit("")))).otherwise(
        F.concat_ws(".", F.when(~blank(base), base), named, folder_name(folder))
    )


def target_file(package: Column, class_name: Column) -> Column:
    return F.concat(F.lit("src/main/java/"), F.translate(package, ".", "/"), F.lit("/"), F.coalesce(class_name, F.lit("null")), F.lit(".java"))


def common_prefix(low: Column, high: Column) -> Column:
    """Common leading segments of two dotted names. Of the least and greatest of many, it is that of all."""
    a, b = F.split(low, r"\."), F.split(high, r"\.")
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    length = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same))
    return F.array_join(F.slice(a, 1, length.cast("int")), ".")


# lines of reports


def _text(*parts: Column | str) -> Column:
    """Parts in a row, null columns as ``null``. A format string would give the same and costs several times as much a row."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("null")) for p in parts))


def violation_message(src_type: Column, src: Column, dst_type: Column, dst: Column) -> Column:
    return _text(src_type, " '", src, "' must not depend on ", dst_type, " '", dst, "'")


def edge_line(src: Column, kind: Column, dst: Column) -> Column:
    return _text(src, " --(", kind, ")--> ", dst)


def node_line(class_name: Column, component: Column) -> Column:
    return _text(class_name, " (", component, ")")


def ordered_lines(line: Column, *order: Column) -> Column:
    """An aggregate: lines joined in order. One group's lines meet in a task: for reports, not for data."""
    rows = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line"))))
    return F.array_join(F.transform(rows, lambda r: r["line"]), "\n")
