"""The tables of the resource graph: columns, keys and references, with types and targets from their names.

A line names a table, its key, and its columns. `!` after a column: never null. `<n`, `=n`: at most, exactly n
characters. `:type` and `>target/action` are given only where the rules below would say otherwise; actions are
C (cascade), R (restrict) and N (set null).
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql.types import DataType, StructField, StructType

from .defs import Check, Column, Reference, Table, Unique

# Names, keys and nullability of the tables.
TABLES = """
core.resource_type (resource_type_code): resource_type_code!<3 logical_name! code_prefix<3 requires_jblr_code! description is_active!
core.resource (resource_id): resource_id!>- resource_type_code!<3>core.resource_type/R jblr_code<32 validation_status! currency_status! created_at!
    created_by_agent_id updated_at! row_version!
core.agent (resource_id): resource_id! agent_kind! display_name! legal_name external_identifiers notes
core.agent_resource_role (agent_resource_role_id): agent_resource_role_id! agent_id! resource_id!>core.resource/R role_code! valid_from:timestamp
    valid_to:timestamp notes
core.geographic_area (resource_id): resource_id! area_kind! name! parent_area_id>core.geographic_area/R external_code external_code_system
    valid_from:date valid_to:date notes
core.resource_set (resource_id): resource_id! set_kind! label! description valid_from:timestamp valid_to:timestamp
core.resource_set_member (resource_set_id, member_resource_id): resource_set_id! member_resource_id! member_role ordinal
evidence.external_source (external_source_id): external_source_id! source_code! source_name! source_type! base_url default_license is_active! notes
evidence.digital_asset (resource_id): resource_id! sha256!=64 size_bytes:bigint media_type storage_uri! original_filename technical_metadata notes
taxonomy.term (term_key): term_key! term_domain! term_code! label! description sort_order is_active!
taxonomy.taxon_concept (resource_id): resource_id! rank_term_key parent_concept_id>taxonomy.taxon_concept/R concept_label according_to_resource_id
    resolution_status! notes
taxonomy.taxonomic_name (resource_id): resource_id! rank_term_key scientific_name! canonical_name! authorship genus specific_epithet
    infraspecific_epithet hybrid_marker nomenclatural_code published_year original_spelling notes
taxonomy.name_usage (resource_id): resource_id! taxon_concept_id! taxonomic_name_id! treatment_resource_id! usage_role! verbatim_name valid_from:date
    valid_to:date notes
taxonomy.nomenclatural_relation (resource_id): resource_id! subject_name_id!>taxonomy.taxonomic_name/R object_name_id!>taxonomy.taxonomic_name/R
    relation_term_key! source_resource_id valid_from:date valid_to:date confidence notes
taxonomy.taxon_concept_relation (resource_id): resource_id! subject_concept_id!>taxonomy.taxon_concept/R object_concept_id!>taxonomy.taxon_concept/R
    relation_type! treatment_resource_id valid_from:date valid_to:date confidence notes
taxonomy.taxon_change_event (resource_id): resource_id! change_type! effective_date decided_by_agent_id source_resource_id rationale notes
taxonomy.taxon_change_event_concept (taxon_change_event_id, taxon_concept_id, event_role): taxon_change_event_id! taxon_concept_id! event_role!
taxonomy.identification (resource_id): resource_id! target_resource_id! taxon_concept_id taxonomic_name_id verbatim_identification
    identified_by_agent_id identified_at:date method_text method_reference_resource_id confidence qualifier resolution_status! is_preferred!
    supersedes_identification_id>taxonomy.identification/R notes
taxonomy.backbone_snapshot (resource_id): resource_id! external_source_id! version_label retrieved_at! dataset_uri checksum digital_asset_id notes
taxonomy.external_taxon_reference (resource_id): resource_id! taxon_concept_id taxonomic_name_id external_source_id! backbone_snapshot_id external_id!
    external_url match_type confidence notes
taxonomy.search_name_assertion (resource_id): resource_id! taxon_concept_id! taxonomic_name_id! search_context! safety_status! valid_from:date
    valid_to:date reviewed_by_agent_id reviewed_at rationale
taxonomy.taxonomic_adoption_decision (resource_id): resource_id! taxon_concept_id! adopted_name_id!>taxonomy.taxonomic_name/R decided_at!
    decided_by_agent_id primary_external_source_id>evidence.external_source/R primary_evidence_resource_id policy_basis is_policy_exception!
    valid_from:date valid_to:date is_current! rationale
taxonomy.regional_taxon_assertion (resource_id): resource_id! taxon_concept_id! geographic_area_id! presence_term_key presence_value_status!
    origin_term_key origin_value_status! establishment_term_key establishment_value_status! context_term_key context_value_status!
    temporality_term_key temporality_value_status! catalog_inclusion_term_key catalog_inclusion_value_status! source_resource_id valid_from:date
    valid_to:date notes
taxonomy.taxonomic_impact_assessment (resource_id): resource_id! taxon_change_event_id! affected_resource_id! historical_assignability impact_term_key
    assessed_by_agent_id assessed_at! rationale
taxonomy.hybrid_parentage (resource_id): resource_id! hybrid_concept_id!>taxonomy.taxon_concept/R parent_concept_id!>taxonomy.taxon_concept/R
    parent_position:smallint confidence source_resource_id notes
field.location (resource_id): resource_id! parent_location_id>field.location/R geographic_area_id location_name verbatim_locality location_kind
    resolution_status! notes
field.location_geometry_version (resource_id): resource_id! location_id! version_no! geom!:binary geometry_role! source_srid:int verbatim_coordinates
    source_geometry_text uncertainty_m georeference_method source_resource_id valid_from:timestamp valid_to:timestamp is_preferred! notes
field.population (resource_id): resource_id! population_label resolution_status! valid_from:date valid_to:date notes
field.population_location (population_location_id): population_location_id! population_id! location_id! relation_role confidence valid_from:date
    valid_to:date notes
field.population_relation (resource_id): resource_id! subject_population_id!>field.population/R object_population_id!>field.population/R
    relation_type! effective_date source_resource_id confidence notes
field.prospection (resource_id): resource_id! started_at ended_at purpose protocol_resource_id coordinator_agent_id notes
field.field_visit (resource_id): resource_id! prospection_id! sequence_no! location_id! started_at ended_at visit_purpose notes
field.field_visit_population (field_visit_id, population_id): field_visit_id! population_id! visit_role
field.individual (resource_id): resource_id! population_id individual_label first_seen_at last_seen_at notes
field.observation (resource_id): resource_id! field_visit_id observed_at population_id individual_id location_id resolution_status!
    verbatim_observation notes
field.census (resource_id): resource_id! field_visit_id! population_id! census_at! method_text notes
field.census_measurement (census_measurement_id): census_measurement_id! census_id! metric_code! life_stage_code value_status! numeric_value unit_code
    notes
field.collection_event (resource_id): resource_id! field_visit_id population_id collection_at method_text permit_reference notes
field.collection_individual (collection_individual_id): collection_individual_id! collection_event_id! individual_id! role_code! sequence_no notes
material.sample (resource_id): resource_id! sample_kind! quantity_value quantity_unit material_state notes
material.sample_origin (sample_origin_id): sample_origin_id! sample_id! collection_event_id individual_id origin_role proportion notes
material.processing_event (resource_id): resource_id! process_type! started_at ended_at operator_agent_id protocol_resource_id notes
material.process_input (process_input_id): process_input_id! processing_event_id! sample_id! quantity_value quantity_unit ordinal
material.process_output (process_output_id): process_output_id! processing_event_id! sample_id! quantity_value quantity_unit ordinal
material.accession (resource_id): resource_id! accession_date accession_status curator_agent_id notes
material.accession_material (accession_material_id): accession_material_id! accession_id! sample_id! material_role quantity_value quantity_unit notes
evidence.bibliographic_reference (resource_id): resource_id! reference_type title authors_text publication_year doi isbn citation_text url
    external_source_id notes
evidence.external_record (resource_id): resource_id! external_source_id! external_id! record_type! canonical_url license_text first_seen_at!
    last_seen_at! notes
evidence.external_record_snapshot (resource_id): resource_id! external_record_id! retrieved_at! payload_hash=64 raw_payload
    raw_asset_id>evidence.digital_asset/R normalized_payload schema_version license_text capture_status! notes
evidence.content_item (resource_id): resource_id! content_kind! title author_agent_id captured_at license_text description notes
evidence.content_representation (resource_id): resource_id! content_item_id! digital_asset_id! representation_role! version_no
    derived_from_representation_id>evidence.content_representation/R transformation_metadata metadata_stripped! created_at! notes
evidence.content_link (content_link_id): content_link_id! content_item_id! target_resource_id! relation_role! notes
evidence.assertion (resource_id): resource_id! subject_resource_id predicate_code statement_text! asserted_by_agent_id asserted_at resolution_status!
    scope_note notes
evidence.evidence_link (evidence_link_id): evidence_link_id! assertion_id! evidence_resource_id! relation_role! confidence notes
governance.data_activity (resource_id): resource_id! activity_type! started_at ended_at performed_by_agent_id software_name software_version
    code_commit parameters process_outcome notes
governance.validation_event (resource_id): resource_id! target_resource_id! from_validation_status to_validation_status! reviewed_by_agent_id
    occurred_at! data_activity_id reason
governance.record_revision (resource_id): resource_id! target_resource_id! revision_no! changed_at! changed_by_agent_id data_activity_id operation!
    reason
governance.revision_change (revision_change_id): revision_change_id! record_revision_id! field_path! old_value new_value change_kind sensitive_value!
governance.quality_assessment (resource_id): resource_id! target_resource_id! assessed_at! assessed_by_agent_id method_text score summary
    data_activity_id
governance.quality_flag (quality_flag_id): quality_flag_id! quality_assessment_id! flag_code! severity detail
governance.import_batch (resource_id): resource_id! data_activity_id! external_source_id source_uri input_asset_id>evidence.digital_asset/R query_text
    idempotency_key source_snapshot_label notes
governance.import_batch_item (import_batch_item_id): import_batch_item_id! import_batch_id! source_item_key source_hash
    external_snapshot_resource_id>evidence.external_record_snapshot/R target_resource_id process_outcome! error_detail occurred_at!
evidence.provenance_link (provenance_link_id): provenance_link_id! subject_resource_id! source_resource_id external_source_id data_activity_id
    generation_mode! relation_role notes
analytics.metric_definition (metric_definition_id): metric_definition_id! metric_code! label! value_type! default_unit_code description is_active!
analytics.metric_target_resource_type (metric_definition_id, resource_type_code): metric_definition_id!>analytics.metric_definition/C
    resource_type_code!<3>core.resource_type/R
analytics.analysis_run (resource_id): resource_id! data_activity_id! module_code! method_version! parameters input_manifest_hash run_status! closed_at
    release_label released_at notes
analytics.analysis_input (analysis_input_id): analysis_input_id! analysis_run_id!>-
"""

#: Tables of which only the beginning is known.
INCOMPLETE = {"analytics.analysis_input"}

# The closed domains.
DOMAINS = {
    "validation": "unreviewed pending_review validated disputed rejected",
    "currency": "current superseded withdrawn",
    "agent_kind": "person organization software team",
    "resolution": "resolved partially_resolved unresolved ambiguous not_applicable",
    "usage_role": "accepted synonym previously_accepted basionym misapplied historical_usage unresolved",
    "concept_relation": "congruent_with includes included_in overlaps disjoint_from uncertain_relationship",
    "change_type": "split lump rank_change accepted_name_change recircumscription other",
    "event_role": "input output affected",
    "search_context": "bibliography herbarium occurrence genetics general_discovery",
    "safety": "automatic_safe reviewed_safe review_required excluded",
    "value_status": "present unknown not_applicable not_recorded not_queried failed",
    "assignability": "securely_assignable partially_assignable not_assignable requires_redetermination",
    "geometry_role": "exact interpreted historical",
    "capture": "captured partial not_available failed",
    "content_kind": "document media",
    "representation_role": "original version derivative thumbnail public_derivative",
    "evidence_role": "supports contradicts corroborates derived_from",
    "import_outcome": "inserted updated unchanged duplicate quarantined failed skipped",
    "value_type": "numeric text boolean json",
    "run_status": "running closed failed",
}

# Checks that the rules by column name (see checks_of) do not give. Each line: table, template, arguments.
CHECKS = r"""
core.resource_type regex resource_type_code ^[A-Z0-9]{3}\z
core.resource_type regex code_prefix ^[A-Z0-9]{3}\z
core.resource enum validation_status validation
core.resource enum currency_status currency
core.resource range row_version 1 -
core.resource regex jblr_code ^JBLR-[A-Z0-9]{3}-[0-9]{8}\z
core.agent enum agent_kind agent_kind
core.resource_set_member range ordinal 0 -
evidence.digital_asset regex sha256 ^[0-9a-fA-F]{64}\z
evidence.digital_asset range size_bytes 0 -
taxonomy.taxon_concept not_same parent_concept_id resource_id
taxonomy.taxonomic_name range published_year 1500 2500
taxonomy.name_usage enum usage_role usage_role
taxonomy.nomenclatural_relation not_same subject_name_id object_name_id
taxonomy.taxon_concept_relation enum relation_type concept_relation
taxonomy.taxon_concept_relation not_same subject_concept_id object_concept_id
taxonomy.taxon_change_event enum change_type change_type
taxonomy.taxon_change_event_concept enum event_role event_role
taxonomy.identification at_least_one taxon_concept_id taxonomic_name_id verbatim_identification
taxonomy.identification not_same supersedes_identification_id resource_id
taxonomy.external_taxon_reference at_least_one taxon_concept_id taxonomic_name_id
taxonomy.search_name_assertion enum search_context search_context
taxonomy.search_name_assertion enum safety_status safety
taxonomy.taxonomic_impact_assessment enum historical_assignability assignability
taxonomy.hybrid_parentage range parent_position 1 2
taxonomy.hybrid_parentage not_same hybrid_concept_id parent_concept_id
field.location not_same parent_location_id resource_id
field.location_geometry_version range version_no 1 -
field.location_geometry_version enum geometry_role geometry_role
field.location_geometry_version range uncertainty_m 0 -
field.location_geometry_version geometry_kind geom 1 2 3 4 5 6
field.population_relation not_same subject_population_id object_population_id
field.field_visit range sequence_no 1 -
field.individual ordered first_seen_at last_seen_at
field.census_measurement iff value_status present numeric_value
field.collection_individual range sequence_no 1 -
material.sample_origin range proportion 0 1
material.sample_origin at_least_one collection_event_id individual_id
material.process_input range ordinal 1 -
material.process_output range ordinal 1 -
evidence.bibliographic_reference range publication_year 1500 2500
evidence.external_record_snapshot regex payload_hash ^[0-9a-fA-F]{64}\z
evidence.external_record_snapshot enum capture_status capture
evidence.external_record_snapshot at_most_one raw_payload raw_asset_id
evidence.content_item enum content_kind content_kind
evidence.content_representation enum representation_role representation_role
evidence.content_representation range version_no 1 -
evidence.content_representation not_same derived_from_representation_id resource_id
evidence.evidence_link enum relation_role evidence_role
evidence.evidence_link not_same assertion_id evidence_resource_id
governance.validation_event enum from_validation_status validation
governance.validation_event enum to_validation_status validation
governance.record_revision range revision_no 1 -
governance.import_batch_item enum process_outcome import_outcome
evidence.provenance_link at_least_one source_resource_id external_source_id data_activity_id
analytics.metric_definition enum value_type value_type
analytics.analysis_run enum run_status run_status
analytics.analysis_run iff run_status closed closed_at
"""

# Unique keys besides the primary ones; after `where`, the rows that one holds for; lower(): of what.
UNIQUES = """
core.resource_type: logical_name
core.resource_type: code_prefix
core.resource: jblr_code
evidence.external_source: source_code
evidence.digital_asset: sha256
taxonomy.term: term_domain term_code
taxonomy.identification: target_resource_id where is_preferred
taxonomy.taxonomic_adoption_decision: taxon_concept_id where is_current
taxonomy.hybrid_parentage: hybrid_concept_id parent_concept_id
field.location_geometry_version: location_id version_no
field.location_geometry_version: location_id where is_preferred
field.field_visit: prospection_id sequence_no
field.collection_individual: collection_event_id individual_id role_code
material.process_input: processing_event_id sample_id
material.process_output: processing_event_id sample_id
material.accession_material: accession_id sample_id material_role
evidence.bibliographic_reference: lower(doi)
evidence.external_record: external_source_id external_id
evidence.external_record_snapshot: external_record_id payload_hash
evidence.content_representation: content_item_id where representation_role = 'original'
evidence.content_link: content_item_id target_resource_id relation_role
governance.record_revision: target_resource_id revision_no
governance.import_batch: data_activity_id
governance.import_batch: idempotency_key
analytics.metric_definition: metric_code
analytics.analysis_run: data_activity_id
"""


def type_of(name: str) -> str:
    if name.endswith("_at"):
        return "timestamp"
    if name.endswith("_date"):
        return "date"
    if name.startswith("is_") or name in ("sensitive_value", "metadata_stripped", "requires_jblr_code"):
        return "boolean"
    if name.endswith(("_no", "_year")) or name in ("ordinal", "row_version", "sort_order"):
        return "int"
    if name == "confidence":
        return "decimal(4,3)"
    if name in ("quantity_value", "numeric_value", "proportion", "uncertainty_m", "score"):
        return "decimal(38,18)"
    if name.endswith(("_payload", "_metadata")) or name in ("parameters", "old_value", "new_value", "error_detail", "external_identifiers"):
        return "variant"
    return "string"


def target_of(name: str, tables: list[str]) -> str | None:
    """What a column refers to, with the action on deletion, by its name."""
    if name == "resource_id":
        return "core.resource/C"
    for end, to in (("_agent_id", "core.agent/N"), ("_resource_id", "core.resource/R"), ("_term_key", "taxonomy.term/R")):
        if name.endswith(end):
            return to
    return next((f"{t}/R" for t in tables if name.endswith("_id") and t.split(".")[1] == name[:-3]), None)


def checks_of(table: str, columns: list[Column]) -> list[Check]:
    names = [c.name for c in columns]
    found = [Check(table, "enum", (n, "resolution")) for n in names if n == "resolution_status"]
    found += [Check(table, "enum", (n, "value_status")) for n in names if n.endswith("value_status")]
    found += [Check(table, "iff", (n, "present", n.replace("value_status", "term_key"))) for n in names if n.endswith("_value_status")]
    found += [Check(table, "range", ("confidence", "0", "1")) for n in names if n == "confidence"]
    found += [Check(table, "range", (n, "0", "-")) for n in names if n == "quantity_value"]
    for a, b in (("valid_from", "valid_to"), ("started_at", "ended_at")):
        if a in names and b in names:
            found.append(Check(table, "ordered", (a, b)))
    return found


# Declared defaults, by column; `only` where not every table that has the column declares it.
DEFAULTS = """
is_active true
requires_jblr_code false
is_preferred false
is_policy_exception false
is_current true
metadata_stripped false
sensitive_value false
row_version 1
validation_status 'unreviewed'
currency_status 'current'
resolution_status 'unresolved'
capture_status 'captured'
presence_value_status 'not_recorded'
origin_value_status 'not_recorded'
establishment_value_status 'not_recorded'
context_value_status 'not_recorded'
temporality_value_status 'not_recorded'
catalog_inclusion_value_status 'not_recorded'
created_at now
updated_at now
occurred_at now
changed_at now
first_seen_at now only evidence.external_record
last_seen_at now only evidence.external_record
assessed_at now only governance.quality_assessment
"""


@cache
def _defaults() -> dict[str, tuple[str, str | None]]:
    """Value and table (None: all) by column."""
    words = [line.split(" ") for line in DEFAULTS.strip().splitlines()]
    return {w[0]: (w[1], w[3] if len(w) > 2 else None) for w in words}


def default_of(table: str, column: str) -> str | None:
    value, only = _defaults().get(column, (None, None))
    return value if only in (None, table) else None


@cache
def catalog() -> dict[str, Table]:
    lines = re.sub(r"\n    ", " ", TABLES.strip()).splitlines()
    heads = [re.fullmatch(r"(\S+) \(([^)]*)\): (.*)", x) for x in lines]
    names = [h[1] for h in heads]
    given: dict[str, list[Check]] = {}
    for line in CHECKS.strip().splitlines():
        table, kind, *arguments = line.split(" ")
        given.setdefault(table, []).append(Check(table, kind, tuple(arguments)))
    uniques: dict[str, list[Unique]] = {}
    for line in UNIQUES.strip().splitlines():
        table, rest = line.split(": ", 1)
        key, _, where = rest.partition(" where ")
        uniques.setdefault(table, []).append(Unique(table, tuple(key.split(" ")), where or None))
    out = {}
    for h in heads:
        columns, references, key = [], [], tuple(h[2].split(", "))
        for word in h[3].split(" "):
            m = re.fullmatch(r"(\w+)(!?)(?::([\w(),]+))?([<=]\d+)?(?:>(\S+))?", word)
            name, never_null, kind, length, target = m.groups()
            columns.append(Column(name, kind or type_of(name), bool(never_null), int(length[1:]) if length else None, bool(length) and length[0] == "=", default_of(h[1], name)))
            target = target_of(name, names) if target is None and not (name in key and name != "resource_id") else target or "-"
            if name in key and name != "resource_id" and target == "-" and len(key) > 1:
                target = target_of(name, names) or "-"
            if target and target != "-":
                references.append(Reference(h[1], name, *target.split("/")))
        checks = [*checks_of(h[1], columns), *given.get(h[1], [])]
        out[h[1]] = Table(h[1], tuple(columns), key, tuple(references), tuple(uniques.get(h[1], [])), tuple(checks), h[1] not in INCOMPLETE)
    return out


def schema_of(table: Table) -> StructType:
    """Every column may be null: Spark does not hold files to it, the not-null rules do."""
    return StructType([StructField(c.name, DataType.fromDDL(c.type), True) for c in table.columns])
