"""Entities and edges of metadata, tables and forms, as unions of projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import entities

# Kinds of metadata fields, and words that tell what a form field refers to.
METADATA = {"title": "document_title", "author": "person", "creator": "person", "subject": "document_metadata", "keywords": "document_metadata", "created_date": "date", "modified_date": "date", "document_type": "document_metadata", "organization": "organization", "publisher": "organization"}
PERSON_WORDS = ["name", "person", "customer", "client", "employee", "author"]
ORGANIZATION_WORDS = ["company", "organization", "business", "employer", "vendor"]
DATE_WORDS = ["date", "day", "month", "year", "birthday", "issued", "created"]


def metadata_entities(df: DataFrame, key: str, metadata: str = "metadata") -> DataFrame:
    """A typed entity for each value of a known field of ``metadata`` (a map of arrays), blank values left out, and the container."""
    kinds = F.create_map(*[F.lit(x) for kv in METADATA.items() for x in kv])
    fields = df.select(key, F.explode(metadata).alias("field", "values")).select(key, "field", F.explode("values").alias("text"), F.try_element_at(kinds, F.col("field")).alias("kind"))
    typed = fields.filter(F.col("kind").isNotNull() & (F.trim("text") != "")).select(key, "kind", "text", "field", F.lit(0.9).alias("confidence"))
    held = df.select(key, F.lit("document_metadata").alias("kind"), F.lit("Document Metadata").alias("text"), F.lit(None).cast("string").alias("field"), F.lit(1.0).alias("confidence"))
    return typed.unionByName(held)


def cells(df: DataFrame, key: str, rows: Column) -> DataFrame:
    """The cells of a table given as an array of arrays: key, row, col, text, with the first row's cell as header; the header is no row."""
    each = df.select(key, rows.alias("_rows")).select(key, F.get("_rows", F.lit(0)).alias("_head"), F.posexplode(F.slice("_rows", F.lit(2), F.greatest(F.lit(0), F.size("_rows") - 1))).alias("row", "_cells"))
    return each.select(key, "row", "_head", F.posexplode("_cells").alias("col", "text")).select(key, "row", "col", F.get("_head", F.col("col")).alias("header"), "text")


def table_entities(df: DataFrame, key: str, rows: Column) -> DataFrame:
    """The pattern entities of each cell that is not blank, with row, column and header."""
    found = cells(df, key, rows).filter(F.trim("text") != "")
    return found.select(key, "row", "col", "header", F.explode(entities(F.col("text"))).alias("e")).select(key, "row", "col", "header", "e.kind", F.col("e.text").alias("text"))


def form_entities(elements: DataFrame) -> DataFrame:
    """Entities of forms: element, value, label, key-value pair and the form itself.

    elements(form, form_type, pos, element, name, value, confidence): element is checkbox, radio, text_field or another; a
    checkbox or radio button is set where its value is 'true'.
    """
    state = lambda yes, no: F.concat("name", F.lit(": "), F.when(F.col("value") == "true", yes).otherwise(no))
    shown = F.when(F.col("element") == "checkbox", state("Checked", "Unchecked")).when(F.col("element") == "radio", state("Selected", "Unselected")).otherwise(F.col("name"))
    kinds = F.create_map(*[F.lit(x) for kv in {"checkbox": "form_checkbox", "radio": "form_radio_button", "text_field": "form_text_field"}.items() for x in kv])
    of = lambda kind, text, confidence: elements.select("form", "pos", kind.alias("kind"), text.alias("text"), confidence.alias("confidence"))
    field = of(F.coalesce(F.try_element_at(kinds, F.col("element")), F.lit("form_field")), shown, F.col("confidence"))
    filled = (F.col("element") == "text_field") & (F.coalesce("value", F.lit("")) != "")
    value = elements.filter(filled).select("form", "pos", F.lit("form_value").alias("kind"), F.col("value").alias("text"), "confidence")
    label = elements.filter("name IS NOT NULL").select("form", "pos", F.lit("form_label").alias("kind"), F.col("name").alias("text"), F.round(F.col("confidence") * 0.9, 6).alias("confidence"))
    pair = elements.filter(F.coalesce("value", F.lit("")) != "").select("form", "pos", F.lit("key_value_pair").alias("kind"), F.concat_ws(": ", "name", "value").alias("text"), "confidence")
    form = elements.groupBy("form", "form_type").agg(F.max("confidence").alias("confidence")).select("form", F.lit(-1).alias("pos"), F.lit("form").alias("kind"), F.concat(F.lit("Form: "), "form_type").alias("text"), "confidence")
    return field.unionByName(value).unionByName(label).unionByName(pair).unionByName(form)


def form_edges(found: DataFrame) -> DataFrame:
    """Edges of form entities: contains, belongs_to, has_value, value_of, labeled_by, labels, has_data, extracted_from; of (form, pos, kind) rows."""
    element = found.filter(F.col("kind").isin("form_checkbox", "form_radio_button", "form_text_field", "form_field")).select("form", "pos")
    out = None
    for kind, there, back in (("element", "contains", "belongs_to"), ("form_value", "has_value", "value_of"), ("form_label", "labeled_by", "labels"), ("key_value_pair", "has_data", "extracted_from")):
        ends = element if kind == "element" else found.filter(F.col("kind") == kind).select("form", "pos")
        confidence = 0.9 if kind == "form_label" else 1.0
        pair = ends.select("form", "pos", F.explode(F.array(F.lit(there), F.lit(back))).alias("relation"), F.lit(confidence).alias("confidence"))
        out = pair if out is None else out.unionByName(pair)
    return out


def _any(name: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w))


def form_relations(fields: DataFrame, others: DataFrame) -> DataFrame:
    """Edges from form fields to the document's entities that the field's name points to; fields(doc, field, name), others(doc, entity, kind)."""
    name = F.lower("name")
    wanted = F.array_compact(F.array(F.when(_any(name, PERSON_WORDS), "person"), F.when(_any(name, ORGANIZATION_WORDS), "organization"), F.when(_any(name, DATE_WORDS), "date")))
    aimed = fields.select("doc", "field", F.explode(wanted).alias("kind"))
    relation = F.when(F.col("kind") == "date", "refers_to_date").otherwise("refers_to")
    return aimed.join(others, ["doc", "kind"]).select("doc", "field", "entity", relation.alias("relation"), F.lit(0.7).alias("confidence"))
