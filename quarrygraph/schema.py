"""Schemas of the property graph tables."""

from __future__ import annotations


# DDL strings: no session is needed to import them
CELLS = "cell_id STRING, space_id STRING, dimension INT, cell_type STRING, label STRING, provenance STRUCT<uri: STRING, title: STRING, confidence: DOUBLE, extraction_method: STRING>"
INCIDENCES = "incidence_id STRING, from_cell_id STRING, to_cell_id STRING, relation_type STRING, file STRING, start_line INT, end_line INT, confidence DOUBLE, derivation_source STRING"
ENTITIES = "fqn STRING, cell_id STRING, entity_type STRING, label STRING, file STRING, start_line INT, end_line INT, start_col INT, end_col INT"
UNRESOLVED = "from_fqn STRING, target_text STRING, relation_type STRING, file STRING, line INT"
ANNOTATIONS = "cell_id STRING, intent STRING, behavior STRING, preconditions ARRAY<STRING>, postconditions ARRAY<STRING>, invariants ARRAY<STRING>, side_effects ARRAY<STRING>, error_behavior STRING"
SOURCE_FILES = "path STRING, text STRING, encoding STRING, lossy BOOLEAN"
SOURCE_LINES = "path STRING, line_no INT, line STRING"
OBSTRUCTIONS = "message STRING"
DIAGNOSTICS = "file STRING, message STRING, severity STRING"

# fixed values: names that graph tables use
ENTITY_TYPES = ("package", "class", "interface", "enum", "enum_constant", "annotation", "record", "method", "constructor", "field")
RELATION_TYPES = ("contained_in", "extends", "implements", "calls", "constructs", "field_access", "throws", "catches", "imports", "annotated_with", "type_reference", "overrides")
CLASS_LIKE = ("java.class", "java.interface", "java.enum", "java.record")
CALLABLE = ("java.method", "java.constructor")
CALLS = ("java.calls", "java.constructs")
REFERENCES = ("java.calls", "java.constructs", "java.field_access")
TYPE_REFERENCES = ("java.extends", "java.implements", "java.imports", "java.type_reference", "java.throws", "java.catches")
IMPACT = ("java.calls", "java.constructs", "java.extends", "java.implements", "java.type_reference")
ANNOTATION_FIELDS = tuple(c.split()[0] for c in ANNOTATIONS.split(", "))
