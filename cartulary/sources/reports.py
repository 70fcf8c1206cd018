"""Report definitions of three kinds read into one table of parameters, fields and bands.

A file is one XML document, read whole in the task that holds it; its parts are
taken by schema, so a part without a type keeps its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PROPERTY = "array<struct<_name:string,_VALUE:string>>"
_NAMED = f"struct<_name:string,property:{_PROPERTY},`text-property`:{_PROPERTY}>"
_SET = f"struct<_name:string,`list-property`:array<struct<_name:string,structure:array<{_NAMED}>>>>"
_SECTIONS = ("title", "pageHeader", "columnHeader", "detail", "columnFooter", "pageFooter", "summary")
_BAND = "struct<band:array<struct<_height:string>>>"
_DECLARED = "array<struct<_name:string,_class:string>>"

#: The schema of each kind, by its root element.
SCHEMAS = {
    "report": f"parameters struct<`scalar-parameter`:array<{_NAMED}>>, `data-sets` struct<`oda-data-set`:array<{_SET}>,`script-data-set`:array<{_SET}>>",
    "jasperReport": f"_name string, parameter {_DECLARED}, field {_DECLARED}, queryString string, {', '.join(f'{s} {_BAND}' for s in _SECTIONS)}",
    "Report": "ReportParameters struct<ReportParameter:array<struct<_Name:string,DataType:string>>>, DataSets struct<DataSet:array<struct<_Name:string,Fields:struct<Field:array<struct<_Name:string,DataField:string,TypeName:string>>>>>>",
}
PARTS = "array<struct<part:string,owner:string,name:string,type:string>>"
#: What stands for a type that a file does not give.
UNKNOWN = "unspecified"


def _part(part: str, owner: Column | None, name: Column, kind: Column) -> Column:
    type_ = F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.lit(UNKNOWN))
    return F.struct(F.lit(part).alias("part"), (owner if owner is not None else F.lit(None).cast("string")).alias("owner"), name.alias("name"), type_.alias("type"))


def _all(*lists: Column) -> Column:
    none = F.array().cast(PARTS)
    return F.concat(*[F.coalesce(x.cast(PARTS), none) for x in lists])


def _said(element: Column, name: str) -> Column:
    """The text of a property, spelt in either of two ways."""
    none = F.array().cast(_PROPERTY)
    both = F.concat(F.coalesce(element["property"], none), F.coalesce(element["text-property"], none))
    return F.get(F.filter(both, lambda p: p["_name"] == name), 0)["_VALUE"]


def _of_design(x: Column) -> Column:
    def fields(kind: str) -> Column:
        def of_set(s: Column) -> Column:
            columns = F.get(F.filter(s["list-property"], lambda p: p["_name"] == "resultSetColumn"), 0)["structure"]
            return F.coalesce(F.transform(columns, lambda c: _part("field", s["_name"], _said(c, "name"), _said(c, "dataType"))).cast(PARTS), F.array().cast(PARTS))

        return F.flatten(F.transform(x["data-sets"][kind], of_set))

    return _all(F.transform(x["parameters"]["scalar-parameter"], lambda p: _part("parameter", None, p["_name"], _said(p, "dataType"))), fields("oda-data-set"), fields("script-data-set"))


def _of_jasper(x: Column) -> Column:
    declared = lambda part: F.transform(x[part], lambda d: _part(part, None, d["_name"], d["_class"]))
    bands = [_bands(x[s]["band"], s) for s in _SECTIONS]
    return _all(declared("parameter"), declared("field"), *bands)


def _bands(bands: Column, section: str) -> Column:
    return F.transform(bands, lambda b: _part("band", None, F.lit(section), b["_height"]))


def _of_definition(x: Column) -> Column:
    of_set = lambda s: F.coalesce(F.transform(s["Fields"]["Field"], lambda f: _part("field", s["_Name"], f["_Name"], f["TypeName"])).cast(PARTS), F.array().cast(PARTS))
    return _all(F.transform(x["ReportParameters"]["ReportParameter"], lambda p: _part("parameter", None, p["_Name"], p["DataType"])), F.flatten(F.transform(x["DataSets"]["DataSet"], of_set)))


_READERS = {"report": _of_design, "jasperReport": _of_jasper, "Report": _of_definition}


def parts_of(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(path, kind, part, owner, name, type)`` of every parameter, field and band, in order of the file; files with
    another root element, and null ones, have none."""
    text = F.regexp_replace(F.regexp_replace(text_col, r"(?s)<\?.*?\?>|<!--.*?-->", ""), r"(?s)<!DOCTYPE[^>]*>", "")
    root = F.regexp_extract("_text", r"^\s*<(?:[A-Za-z]+:)?([A-Za-z]+)", 1)
    known = files.select(F.col(path_col).alias("path"), text.alias("_text")).withColumn("kind", root).where(F.col("kind").isin(*SCHEMAS))
    found = F.lit(None).cast(PARTS)
    for kind, schema in SCHEMAS.items():
        found = F.when(F.col("kind") == kind, _READERS[kind](F.from_xml("_text", schema, {"ignoreNamespace": "true", "attributePrefix": "_"}))).otherwise(found)
    return known.select("path", "kind", F.posexplode(found).alias("place", "p")).select("path", "kind", "place", "p.*")


def report_parts(spark: SparkSession, folder: str) -> DataFrame:
    """``parts_of`` every file below ``folder``."""
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return parts_of(files.select(F.input_file_name().alias("path"), F.col("value").alias("text")))
