"""Questions over small tables of the catalogue, and the advisory rules."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lattica.model.catalog import catalog, schema_of
from lattica.plans import questions as q
from lattica.rules import advisory

D, T = date(2024, 6, 1), datetime(2024, 6, 1)


class Tables(dict):
    """Tables of the catalogue from rows given as dictionaries; JSON for variants; empty where none are given."""

    def __init__(self, spark, **rows):
        self.spark, self.given = spark, {k.replace("__", "."): v for k, v in rows.items()}

    def __missing__(self, name):
        schema = schema_of(catalog()[name])
        plain = ", ".join(f"{f.name} {'string' if f.dataType.simpleString() == 'variant' else f.dataType.simpleString()}" for f in schema)
        values = [tuple(r.get(f.name) for f in schema) for r in self.given.get(name, [])]
        df = self.spark.createDataFrame(values, plain)
        for f in schema:
            if f.dataType.simpleString() == "variant":
                df = df.withColumn(f.name, F.parse_json(f.name))
        self[name] = df
        return df


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def names(**more):
    return dict(taxonomy__taxonomic_name=[{"resource_id": "n1", "scientific_name": "A b"}, {"resource_id": "n2", "scientific_name": "A c"}], **more)


def test_names(spark):
    usage = [{"taxon_concept_id": "c1", "taxonomic_name_id": "n1", "usage_role": "accepted", "valid_to": date(2024, 1, 1)}, {"taxon_concept_id": "c1", "taxonomic_name_id": "n2", "usage_role": "accepted", "valid_from": date(2024, 1, 1)}, {"taxon_concept_id": "c1", "taxonomic_name_id": "n1", "usage_role": "synonym"}]
    t = Tables(spark, **names(taxonomy__name_usage=usage, taxonomy__taxonomic_adoption_decision=[{"taxon_concept_id": "c1", "adopted_name_id": "n2", "is_current": True, "is_policy_exception": True}, {"taxon_concept_id": "c1", "adopted_name_id": "n1", "is_current": False}],
        taxonomy__search_name_assertion=[{"taxon_concept_id": "c1", "taxonomic_name_id": "n1", "search_context": "herbarium", "safety_status": "automatic_safe"}, {"taxon_concept_id": "c1", "taxonomic_name_id": "n2", "search_context": "herbarium", "safety_status": "excluded"}]))
    assert rows(q.accepted_names(t, D)) == [("c1", "A c")]
    assert rows(q.adopted_names(t)) == [("c1", "A c", True)]
    assert rows(q.usable_names(t, "herbarium", D)) == [("c1", "A b", "automatic_safe")]


def test_concepts(spark):
    relation = [{"subject_concept_id": "a", "object_concept_id": "b", "relation_type": "congruent_with"}, {"subject_concept_id": "c", "object_concept_id": "b", "relation_type": "congruent_with"}, {"subject_concept_id": "a", "object_concept_id": "d", "relation_type": "includes"}]
    t = Tables(spark, taxonomy__taxon_concept_relation=relation, taxonomy__taxon_change_event_concept=[{"taxon_change_event_id": "e", "taxon_concept_id": "a", "event_role": "input"}],
        taxonomy__identification=[{"resource_id": "i", "taxon_concept_id": "a", "target_resource_id": "x"}, {"resource_id": "j", "taxon_concept_id": "a", "target_resource_id": "y"}],
        taxonomy__taxonomic_impact_assessment=[{"taxon_change_event_id": "e", "affected_resource_id": "x"}], taxonomy__hybrid_parentage=[{"hybrid_concept_id": "h", "parent_concept_id": "p"}, {"hybrid_concept_id": "p", "parent_concept_id": "r"}],
        taxonomy__external_taxon_reference=[{"external_source_id": "s", "external_id": "1", "taxonomic_name_id": "n", "backbone_snapshot_id": "k"}],
        taxonomy__regional_taxon_assertion=[{"taxon_concept_id": "a", "geographic_area_id": "g", "presence_value_status": "present", "presence_term_key": "t", "origin_value_status": "unknown"}], taxonomy__term=[{"term_key": "t", "label": "here"}])
    assert ("a", "c") in rows(q.aligned_concepts(t)) and all("d" not in r for r in rows(q.aligned_concepts(t)))
    assert rows(q.change_impact(t), "target_resource_id", "assessed") == [("x", True), ("y", False)]
    assert rows(q.pedigree(t)) == [("h", "p", 1), ("h", "r", 2), ("p", "r", 1)]
    assert rows(q.external_matches(t, "k"), "external_id", "matched_id") == [("1", "n")]
    assert ("presence", "present", "here") in rows(q.checklist(t), "aspect", "value_status", "label") and q.checklist(t).count() == 6


def test_field_work(spark):
    t = Tables(spark, field__location=[{"resource_id": "l1"}, {"resource_id": "l2", "parent_location_id": "l1"}, {"resource_id": "l3"}], field__location_geometry_version=[{"location_id": "l1", "geom": bytearray(b"g"), "is_preferred": True}],
        field__field_visit=[{"resource_id": "v", "prospection_id": "p", "sequence_no": 1, "started_at": T, "ended_at": datetime(2024, 6, 1, 0, 1)}], field__field_visit_population=[{"field_visit_id": "v", "population_id": "b"}, {"field_visit_id": "v", "population_id": "a"}],
        field__census=[{"resource_id": "c1", "population_id": "b", "census_at": T}, {"resource_id": "c2", "population_id": "b", "census_at": datetime(2024, 7, 1)}],
        field__census_measurement=[{"census_id": c, "metric_code": "m", "value_status": s, "numeric_value": Decimal(v) if v else None, "unit_code": u} for c, s, v, u in (("c1", "present", 3, "kg"), ("c1", "present", 4, "kg"), ("c1", "present", 9, "g"), ("c2", "present", 10, "kg"), ("c2", "unknown", None, "kg"))],
        field__individual=[{"resource_id": "i", "first_seen_at": T, "last_seen_at": T}], field__observation=[{"resource_id": "o", "individual_id": "i", "observed_at": T}])
    assert rows(q.geometries(t), "location_id", "taken_from") == [("l1", "l1"), ("l2", "l1"), ("l3", None)]
    assert rows(q.itinerary(t), "seconds", "populations") == [(60.0, ["a", "b"])]
    assert [(r["total"], r["delta"]) for r in q.trend(t).filter("unit_code = 'kg'").orderBy("census_at").collect()] == [(7, None), (10, 3)]
    assert rows(q.sightings(t), "resource_id", "agrees") == [("i", True)]


def test_material(spark):
    t = Tables(spark, material__accession_material=[{"accession_id": "a", "sample_id": "s"}], material__sample_origin=[{"sample_id": "s", "collection_event_id": "c"}], field__collection_event=[{"resource_id": "c", "population_id": "p"}], taxonomy__identification=[{"target_resource_id": "p", "taxon_concept_id": "k", "is_preferred": True}],
        material__process_input=[{"processing_event_id": "e", "sample_id": "s", "quantity_value": Decimal(5), "quantity_unit": "g"}], material__process_output=[{"processing_event_id": "e", "sample_id": "s2", "quantity_value": Decimal(4), "quantity_unit": "g"}])
    assert rows(q.accession_chain(t)) == [("a", "s", "c", "p", "k")]
    assert rows(q.sample_lineage(t)) == [("s2", "s", 1)]
    assert rows(q.balance(t), "processing_event_id", "quantity_in", "quantity_out") == [("e", 5, 4)]


def test_evidence(spark):
    t = Tables(spark, evidence__bibliographic_reference=[{"resource_id": "a", "doi": "10.1/A", "title": "flora of the coast"}, {"resource_id": "b", "doi": "10.1/a"}, {"resource_id": "c", "title": "Flora of the coasts"}],
        evidence__external_record_snapshot=[{"resource_id": "1", "external_record_id": "r", "retrieved_at": T, "payload_hash": "x", "normalized_payload": '{"a":1,"b":2}'}, {"resource_id": "2", "external_record_id": "r", "retrieved_at": datetime(2024, 7, 1), "payload_hash": "y", "normalized_payload": '{"b":2,"a":1}'}],
        evidence__content_representation=[{"resource_id": "o", "content_item_id": "i", "representation_role": "original", "metadata_stripped": False}, {"resource_id": "p", "content_item_id": "i", "representation_role": "public_derivative", "metadata_stripped": True, "derived_from_representation_id": "o"}],
        evidence__evidence_link=[{"assertion_id": "z", "relation_role": "supports", "confidence": Decimal("0.5")}, {"assertion_id": "z", "relation_role": "contradicts"}, {"assertion_id": "w", "relation_role": "supports"}],
        evidence__provenance_link=[{"subject_resource_id": "x", "source_resource_id": "y"}, {"subject_resource_id": "y", "external_source_id": "s"}], evidence__external_source=[{"external_source_id": "s", "source_name": "S"}])
    assert rows(q.duplicate_references(t)) == [("a", "b", "doi"), ("a", "c", "title")]
    assert rows(q.latest_snapshots(t), "resource_id", "changed") == [("2", True)] and q.payload_changes(t).count() == 0
    assert rows(q.publishable(t)) == [("i", "p", "o")]
    assert rows(q.contested(t), "assertion_id") == [("z",)]
    assert rows(q.provenance(t)) == [("x", "S"), ("y", "S")]


def test_governance(spark):
    t = Tables(spark, core__resource=[{"resource_id": "r", "resource_type_code": "AAA", "validation_status": "unreviewed"}], governance__validation_event=[{"resource_id": "1", "target_resource_id": "r", "to_validation_status": "validated", "occurred_at": T}, {"resource_id": "2", "target_resource_id": "r", "from_validation_status": "disputed", "to_validation_status": "rejected", "occurred_at": datetime(2024, 7, 1)}],
        governance__record_revision=[{"resource_id": "v", "target_resource_id": "r", "revision_no": 1, "changed_at": T}, {"resource_id": "w", "target_resource_id": "r", "revision_no": 2, "changed_at": datetime(2024, 8, 1)}], governance__revision_change=[{"record_revision_id": "v", "field_path": "f", "new_value": "1"}, {"record_revision_id": "w", "field_path": "f", "new_value": "2"}],
        governance__quality_assessment=[{"resource_id": "k", "target_resource_id": "r", "assessed_at": T, "score": Decimal(1)}], governance__quality_flag=[{"quality_assessment_id": "k", "flag_code": "x", "severity": "high"}],
        governance__import_batch=[{"resource_id": "b"}], governance__import_batch_item=[{"import_batch_id": "b", "process_outcome": "inserted"}, {"import_batch_id": "b", "process_outcome": "failed"}],
        analytics__analysis_run=[{"resource_id": "a", "module_code": "m", "released_at": T}, {"resource_id": "c", "module_code": "m"}], analytics__metric_definition=[{"metric_definition_id": "d", "metric_code": "h", "is_active": True}], analytics__metric_target_resource_type=[{"metric_definition_id": "d", "resource_type_code": "AAA"}])
    assert rows(q.backlog(t)) == [("AAA", "unreviewed", 1)]
    assert rows(q.broken_histories(t), "resource_id", "expected") == [("2", "validated")]
    assert rows(q.record_at(t, "2024-07-01"), "field_path", "value") == [("f", "1")]
    assert rows(q.quality(t), "score", "flags") == [(1, ["high:x"])]
    assert rows(q.import_report(t), "inserted", "failed", "updated") == [(1, 1, 0)]
    assert rows(q.released_runs(t), "resource_id") == [("a",)] and rows(q.applicable_metrics(t)) == [("AAA", "h")]
    assert rows(advisory.status_behind_events(t["core.resource"], t["governance.validation_event"]), "to_validation_status") == [("rejected",)]


@pytest.fixture
def types(spark):
    return Tables(spark, core__resource_type=[{"resource_type_code": "AAA", "requires_jblr_code": True, "code_prefix": "AAA"}])["core.resource_type"]


def test_advice(spark, types):
    t = Tables(spark, core__resource=[{"resource_id": "a", "resource_type_code": "AAA"}, {"resource_id": "b", "resource_type_code": "AAA", "jblr_code": "JBLR-BBB-00000001"}, {"resource_id": "c", "resource_type_code": "AAA", "jblr_code": "JBLR-AAA-00000001"}],
        core__geographic_area=[{"resource_id": "x", "parent_area_id": "y"}, {"resource_id": "y", "parent_area_id": "x"}, {"resource_id": "z", "parent_area_id": "z"}], evidence__digital_asset=[{"sha256": "AB"}, {"sha256": "ab"}, {"sha256": "cd"}],
        field__census_measurement=[{"metric_code": "m"}], field__field_visit=[{"prospection_id": "p", "sequence_no": 1}, {"prospection_id": "p", "sequence_no": 4}], taxonomy__identification=[{"target_resource_id": "t", "is_preferred": False}])
    assert rows(advisory.code_without_reason(t["core.resource"], types)) == [("a", "missing_code"), ("b", "other_prefix")]
    assert rows(advisory.cyclic_parents(t["core.geographic_area"], "resource_id", "parent_area_id")) == [("x", 2), ("y", 2), ("z", 1)]
    assert rows(advisory.same_digest(t["evidence.digital_asset"])) == [("ab", 2)]
    assert rows(advisory.unknown_metrics(t["field.census_measurement"], t["analytics.metric_definition"])) == [("m",)]
    assert rows(advisory.open_sequences(t["field.field_visit"], ["prospection_id"], "sequence_no"), "after_no", "before_no") == [(1, 4)]
    assert rows(advisory.without_preferred(t["taxonomy.identification"], "target_resource_id", "is_preferred")) == [("t",)]
    usage = Tables(spark, taxonomy__name_usage=[{"resource_id": "1", "taxon_concept_id": "c"}, {"resource_id": "2", "taxon_concept_id": "c", "valid_from": D}])["taxonomy.name_usage"]
    assert rows(advisory.overlapping_validity(usage, "taxon_concept_id", "resource_id")) == [("c", "1", "2")]
