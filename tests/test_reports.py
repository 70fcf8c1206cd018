"""Report definitions of three kinds, written by hand."""

from cartulary.sources import reports

DESIGN = """<?xml version="1.0"?><!-- a design --><report xmlns="http://x/design" version="3.2">
<parameters><scalar-parameter name="from" id="1"><property name="dataType">date</property><text-property name="promptText">From</text-property></scalar-parameter><scalar-parameter name="who"/></parameters>
<data-sets><oda-data-set name="sales"><list-property name="other"><structure><property name="name">no</property></structure></list-property>
<list-property name="resultSetColumn"><structure><property name="name">total</property><property name="dataType">decimal</property></structure><structure><property name="name">day</property></structure></list-property></oda-data-set>
<script-data-set name="none"/></data-sets></report>"""
JASPER = """<!DOCTYPE jasperReport PUBLIC "x" "y"><jasperReport xmlns="http://jasper" name="r"><parameter name="id" class="java.lang.Long"/><field name="amount" class="java.math.BigDecimal"/><field name="note"/>
<title><band height="20"/></title><detail><band height="15"><textField/></band><band height="9"/></detail></jasperReport>"""
RDL = """<Report xmlns="http://ssrs" xmlns:rd="http://designer"><DataSets><DataSet Name="Orders"><Fields><Field Name="Id"><DataField>id</DataField><rd:TypeName>System.Int32</rd:TypeName></Field><Field Name="Sum"><Value>=1</Value></Field></Fields></DataSet></DataSets>
<ReportParameters><ReportParameter Name="Year"><DataType>Integer</DataType></ReportParameter></ReportParameters></Report>"""


def test_parts_of_three_kinds(spark, tmp_path):
    for name, text in (("a.rptdesign", DESIGN), ("sub/b.jrxml", JASPER), ("c.rdl", RDL), ("d.xml", "<other/>"), ("e.txt", "no markup")):
        file = tmp_path / name
        file.parent.mkdir(exist_ok=True)
        file.write_text(text)
    found = {}
    for r in reports.report_parts(spark, str(tmp_path)).orderBy("path", "place").collect():
        found.setdefault(r.kind, []).append((r.part, r.owner, r.name, r.type))
    assert found == {
        "report": [("parameter", None, "from", "date"), ("parameter", None, "who", "unspecified"), ("field", "sales", "total", "decimal"), ("field", "sales", "day", "unspecified")],
        "jasperReport": [("parameter", None, "id", "java.lang.Long"), ("field", None, "amount", "java.math.BigDecimal"), ("field", None, "note", "unspecified"), ("band", None, "title", "20"), ("band", None, "detail", "15"), ("band", None, "detail", "9")],
        "Report": [("parameter", None, "Year", "Integer"), ("field", "Orders", "Id", "System.Int32"), ("field", "Orders", "Sum", "unspecified")],
    }
    assert reports.parts_of(spark.createDataFrame([(1, None), (2, "<report"), (3, "")], "path int, text string")).count() == 0
