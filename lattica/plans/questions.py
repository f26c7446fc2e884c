"""Questions that the resource graph is shaped to answer, as plans over its tables.

Each takes the tables by their name in the catalogue, and gives a plan; nothing is run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import documents
from ..operators import graph, search, temporal, versions

Tables = dict[str, DataFrame]

#: Relations between concepts and what each is seen from the other side.
INVERSE = {"congruent_with": "congruent_with", "overlaps": "overlaps", "disjoint_from": "disjoint_from", "includes": "included_in", "included_in": "includes"}


def accepted_names(t: Tables, on) -> DataFrame:
    """The accepted name of each concept on a date."""
    valid = temporal.valid_at(F.col("valid_from"), F.col("valid_to"), F.lit(on).cast("date"))
    usage = t["taxonomy.name_usage"].filter((F.col("usage_role") == "accepted") & valid)
    names = t["taxonomy.taxonomic_name"].select(F.col("resource_id").alias("taxonomic_name_id"), "scientific_name")
    return usage.join(names, "taxonomic_name_id").select("taxon_concept_id", "scientific_name")


def adopted_names(t: Tables) -> DataFrame:
    """The name currently adopted for each concept, and whether it is an exception to the policy."""
    names = t["taxonomy.taxonomic_name"].select(F.col("resource_id").alias("adopted_name_id"), "scientific_name")
    return t["taxonomy.taxonomic_adoption_decision"].filter("is_current").join(names, "adopted_name_id").select("taxon_concept_id", "scientific_name", "is_policy_exception")


def usable_names(t: Tables, context: str, on) -> DataFrame:
    """Names that may be searched for in a context without review."""
    rows = t["taxonomy.search_name_assertion"].filter((F.col("search_context") == context) & F.col("safety_status").isin("automatic_safe", "reviewed_safe"))
    rows = rows.filter(temporal.valid_at(F.col("valid_from"), F.col("valid_to"), F.lit(on).cast("date")))
    names = t["taxonomy.taxonomic_name"].select(F.col("resource_id").alias("taxonomic_name_id"), "scientific_name")
    return rows.join(names, "taxonomic_name_id").select("taxon_concept_id", "scientific_name", "safety_status")


def aligned_concepts(t: Tables) -> DataFrame:
    """Concepts that are congruent, directly or by others: child, ancestor."""
    edges = graph.symmetrized(t["taxonomy.taxon_concept_relation"], "subject_concept_id", "object_concept_id", "relation_type", INVERSE)
    same = edges.filter("relation_type = 'congruent_with'").select(F.col("subject_concept_id").alias("child"), F.col("object_concept_id").alias("parent"))
    return graph.closure(same).filter("child != ancestor").select("child", "ancestor")


def change_impact(t: Tables) -> DataFrame:
    """What each change touches, and whether that has been assessed."""
    touched = t["taxonomy.taxon_change_event_concept"].filter("event_role in ('input', 'affected')")
    found = touched.join(t["taxonomy.identification"].select("taxon_concept_id", "target_resource_id"), "taxon_concept_id")
    done = t["taxonomy.taxonomic_impact_assessment"].select("taxon_change_event_id", F.col("affected_resource_id").alias("target_resource_id"), "historical_assignability").withColumn("assessed", F.lit(True))
    both = found.select("taxon_change_event_id", "target_resource_id").distinct().join(done, ["taxon_change_event_id", "target_resource_id"], "left")
    return both.select("taxon_change_event_id", "target_resource_id", F.coalesce("assessed", F.lit(False)).alias("assessed"), "historical_assignability")


def checklist(t: Tables) -> DataFrame:
    """Each aspect of each concept in each area, with its term or the reason why there is none."""
    aspects = ("presence", "origin", "establishment", "context", "temporality", "catalog_inclusion")
    pairs = F.array(*(F.struct(F.lit(a).alias("aspect"), F.col(f"{a}_value_status").alias("value_status"), F.col(f"{a}_term_key").alias("term_key")) for a in aspects))
    rows = t["taxonomy.regional_taxon_assertion"].select("taxon_concept_id", "geographic_area_id", F.explode(pairs).alias("p")).select("taxon_concept_id", "geographic_area_id", "p.*")
    return rows.join(t["taxonomy.term"].select("term_key", "label"), "term_key", "left").select("taxon_concept_id", "geographic_area_id", "aspect", "value_status", "label")


def external_matches(t: Tables, snapshot: str) -> DataFrame:
    """External ids of one backbone snapshot, with the concept or else the name that each was matched to."""
    rows = t["taxonomy.external_taxon_reference"].filter(F.col("backbone_snapshot_id") == snapshot)
    return rows.select("external_source_id", "external_id", F.coalesce("taxon_concept_id", "taxonomic_name_id").alias("matched_id"), "match_type", "confidence")


def pedigree(t: Tables) -> DataFrame:
    """All parents of hybrids, by generation."""
    edges = t["taxonomy.hybrid_parentage"].select(F.col("hybrid_concept_id").alias("child"), F.col("parent_concept_id").alias("parent"))
    return graph.closure(edges).select("child", "ancestor", F.col("distance").alias("generation"))


def geometries(t: Tables) -> DataFrame:
    """Each location's preferred geometry, else that of the nearest location above that has one."""
    edges = t["field.location"].filter("parent_location_id is not null").select(F.col("resource_id").alias("child"), F.col("parent_location_id").alias("parent"))
    reach = graph.closure(edges).filter("child != ancestor").unionByName(t["field.location"].select(F.col("resource_id").alias("child"), F.col("resource_id").alias("ancestor"), F.lit(0).alias("distance")))
    own = t["field.location_geometry_version"].filter("is_preferred").select(F.col("location_id").alias("ancestor"), "geom")
    found = reach.join(own, "ancestor").groupBy("child").agg(F.min_by(F.struct("geom", "ancestor"), "distance").alias("g"))
    return t["field.location"].select(F.col("resource_id").alias("child")).join(found, "child", "left").select(F.col("child").alias("location_id"), "g.geom", F.col("g.ancestor").alias("taken_from"))


def itinerary(t: Tables) -> DataFrame:
    """Visits of each prospection in order, how long each took, and the populations seen."""
    seen = t["field.field_visit_population"].groupBy(F.col("field_visit_id").alias("resource_id")).agg(F.array_sort(F.collect_list("population_id")).alias("populations"))
    took = (temporal.moments(F.col("ended_at")) - temporal.moments(F.col("started_at"))) / 1e6
    return t["field.field_visit"].join(seen, "resource_id", "left").select("prospection_id", "sequence_no", F.col("resource_id").alias("field_visit_id"), took.alias("seconds"), "populations")


def trend(t: Tables) -> DataFrame:
    """Totals of each census by population, metric, stage and unit, and the change since the census before. Units are never summed together."""
    keys = ["population_id", "metric_code", "life_stage_code", "unit_code"]
    rows = t["field.census_measurement"].filter("value_status = 'present'").join(t["field.census"].select(F.col("resource_id").alias("census_id"), "population_id", "census_at"), "census_id")
    totals = rows.groupBy(*keys, "census_id", "census_at").agg(F.sum("numeric_value").alias("total"))
    return versions.deltas(totals, keys, "total", [F.asc("census_at"), F.asc("census_id")])


def sightings(t: Tables) -> DataFrame:
    """First and last observation of each individual, and whether what is stored agrees."""
    seen = t["field.observation"].filter("individual_id is not null").groupBy(F.col("individual_id").alias("resource_id")).agg(F.min("observed_at").alias("first"), F.max("observed_at").alias("last"))
    agrees = F.col("first_seen_at").eqNullSafe(F.col("first")) & F.col("last_seen_at").eqNullSafe(F.col("last"))
    return t["field.individual"].join(seen, "resource_id", "left").select("resource_id", "first", "last", agrees.alias("agrees"))


def accession_chain(t: Tables) -> DataFrame:
    """From accessions over samples and collections to populations and identified concepts."""
    rows = t["material.accession_material"].select("accession_id", "sample_id").join(t["material.sample_origin"].select("sample_id", "collection_event_id"), "sample_id")
    rows = rows.join(t["field.collection_event"].select(F.col("resource_id").alias("collection_event_id"), "population_id"), "collection_event_id", "left")
    known = t["taxonomy.identification"].filter("is_preferred").select(F.col("target_resource_id").alias("population_id"), "taxon_concept_id")
    return rows.join(known, "population_id", "left").select("accession_id", "sample_id", "collection_event_id", "population_id", "taxon_concept_id")


def sample_lineage(t: Tables) -> DataFrame:
    """Samples that each sample was made from, over any number of processes."""
    made = t["material.process_output"].select("processing_event_id", F.col("sample_id").alias("child"))
    edges = made.join(t["material.process_input"].select("processing_event_id", F.col("sample_id").alias("parent")), "processing_event_id").select("child", "parent")
    return graph.closure(edges)


def balance(t: Tables) -> DataFrame:
    """What goes into and comes out of each process, by unit: both sides in one aggregate."""
    side = lambda name, n: t[name].select("processing_event_id", "quantity_unit", F.lit(n).alias("side"), "quantity_value")
    rows = side("material.process_input", "in").unionByName(side("material.process_output", "out"))
    sums = [F.sum(F.when(F.col("side") == n, F.col("quantity_value"))).alias(f"quantity_{n}") for n in ("in", "out")]
    return rows.groupBy("processing_event_id", "quantity_unit").agg(*sums)


def duplicate_references(t: Tables, least: float = 0.6) -> DataFrame:
    """Pairs of bibliographic references with one DOI but for case, or much the same title."""
    rows = t["evidence.bibliographic_reference"].select("resource_id", F.lower("doi").alias("doi"), "title")
    by_doi = rows.filter("doi is not null")
    a = by_doi.select(F.col("resource_id").alias("a_id"), "doi").join(by_doi.select(F.col("resource_id").alias("b_id"), "doi"), "doi").filter("a_id < b_id").select("a_id", "b_id", F.lit("doi").alias("by"))
    titled = rows.filter("title is not null")
    b = search.similar(titled.withColumnRenamed("resource_id", "a_id"), "a_id", "title", titled.withColumnRenamed("resource_id", "b_id"), "b_id", "title", least)
    return a.unionByName(b.filter("a_id < b_id").select("a_id", "b_id", F.lit("title").alias("by")))


def latest_snapshots(t: Tables) -> DataFrame:
    """The latest snapshot of each external record and whether its payload differs from the one before."""
    before = F.lag("payload_hash").over(Window.partitionBy("external_record_id").orderBy(F.asc_nulls_first("retrieved_at"), "resource_id"))
    marked = t["evidence.external_record_snapshot"].withColumn("changed", before.isNotNull() & ~before.eqNullSafe(F.col("payload_hash")))
    return versions.latest(marked, ["external_record_id"], [F.desc_nulls_last("retrieved_at"), F.desc("resource_id")]).select("external_record_id", "resource_id", "retrieved_at", "changed")


def publishable(t: Tables) -> DataFrame:
    """Public representations without metadata, each with the original that it comes from."""
    rows = t["evidence.content_representation"]
    edges = rows.filter("derived_from_representation_id is not null").select(F.col("resource_id").alias("child"), F.col("derived_from_representation_id").alias("parent"))
    originals = rows.filter("representation_role = 'original'").select(F.col("resource_id").alias("ancestor"))
    up = graph.closure(edges).join(originals, "ancestor").select(F.col("child").alias("resource_id"), F.col("ancestor").alias("original_id"))
    return rows.filter("representation_role = 'public_derivative' and metadata_stripped").join(up, "resource_id", "left").select("content_item_id", "resource_id", "original_id")


def contested(t: Tables) -> DataFrame:
    """Assertions both supported and contradicted, with the confidence on each side."""
    side = lambda roles: F.sum(F.when(F.col("relation_role").isin(*roles), F.coalesce("confidence", F.lit(1))))
    sums = t["evidence.evidence_link"].groupBy("assertion_id").agg(side(("supports", "corroborates")).alias("supports"), side(("contradicts",)).alias("contradicts"))
    return sums.filter("supports is not null and contradicts is not null")


def backlog(t: Tables) -> DataFrame:
    """Resources by type that wait for review."""
    return t["core.resource"].filter("validation_status in ('unreviewed', 'pending_review')").groupBy("resource_type_code", "validation_status").agg(F.count("*").alias("n"))


def broken_histories(t: Tables) -> DataFrame:
    """Review events whose starting status is not the one that the event before left."""
    moved = versions.transitions(t["governance.validation_event"], ["target_resource_id"], "to_validation_status", [F.asc("occurred_at"), F.asc("resource_id")])
    return moved.filter("from_state is not null and not (from_state <=> from_validation_status)").select("target_resource_id", "resource_id", F.col("from_state").alias("expected"), "from_validation_status")


def record_at(t: Tables, moment) -> DataFrame:
    """Each field of each record as of a moment, as JSON."""
    changes = t["governance.revision_change"].join(t["governance.record_revision"].select(F.col("resource_id").alias("record_revision_id"), "target_resource_id", "revision_no", "changed_at"), "record_revision_id")
    own = changes.select("target_resource_id", "field_path", "revision_no", "changed_at", F.to_json("new_value").alias("value"))
    return versions.state_at(own, ["target_resource_id", "field_path"], "changed_at", F.lit(moment).cast("timestamp"), "value", "revision_no")


def quality(t: Tables) -> DataFrame:
    """The latest score of each resource and its flags by severity."""
    latest = versions.latest(t["governance.quality_assessment"], ["target_resource_id"], [F.desc_nulls_last("assessed_at"), F.desc("resource_id")])
    flags = t["governance.quality_flag"].groupBy(F.col("quality_assessment_id").alias("resource_id")).agg(F.array_sort(F.collect_set(F.concat_ws(":", "severity", "flag_code"))).alias("flags"))
    return latest.join(flags, "resource_id", "left").select("target_resource_id", "score", "flags")


def import_report(t: Tables) -> DataFrame:
    """Outcomes of each batch."""
    outcomes = "inserted updated unchanged duplicate quarantined failed skipped".split()
    counts = t["governance.import_batch_item"].groupBy("import_batch_id").pivot("process_outcome", outcomes).agg(F.count(F.lit(1))).na.fill(0)
    return counts.join(t["governance.import_batch"].select(F.col("resource_id").alias("import_batch_id"), "external_source_id"), "import_batch_id", "left")


def provenance(t: Tables) -> DataFrame:
    """External sources that each resource goes back to."""
    links = t["evidence.provenance_link"]
    edges = links.filter("source_resource_id is not null").select(F.col("subject_resource_id").alias("child"), F.col("source_resource_id").alias("parent"))
    own = links.filter("external_source_id is not null").select(F.col("subject_resource_id").alias("ancestor"), "external_source_id")
    far = graph.closure(edges).join(own, "ancestor").select(F.col("child").alias("resource_id"), "external_source_id")
    found = far.unionByName(own.select(F.col("ancestor").alias("resource_id"), "external_source_id")).distinct()
    return found.join(t["evidence.external_source"].select("external_source_id", "source_name"), "external_source_id").select("resource_id", "source_name")


def released_runs(t: Tables, most: int = 10) -> DataFrame:
    """The latest released runs of each module."""
    rows = t["analytics.analysis_run"].filter("released_at is not null")
    n = F.row_number().over(Window.partitionBy("module_code").orderBy(F.desc("released_at"), "resource_id"))
    return rows.withColumn("n", n).filter(F.col("n") <= most).select("module_code", "resource_id", "released_at")


def applicable_metrics(t: Tables) -> DataFrame:
    """Metrics by the resource types that they apply to."""
    metrics = t["analytics.metric_definition"].filter("is_active").select("metric_definition_id", "metric_code")
    return t["analytics.metric_target_resource_type"].join(metrics, "metric_definition_id").select("resource_type_code", "metric_code")


def payload_changes(t: Tables) -> DataFrame:
    """Snapshots whose normalised payload differs from the one before, whatever the order of its keys."""
    order = Window.partitionBy("external_record_id").orderBy(F.asc_nulls_first("retrieved_at"), "resource_id")
    rows = t["evidence.external_record_snapshot"].select("external_record_id", "resource_id", "retrieved_at", F.to_json("normalized_payload").alias("now"))
    rows = rows.withColumn("before", F.lag("now").over(order)).filter("before is not null")
    return rows.filter(documents.changed(F.col("before"), F.col("now"))).select("external_record_id", "resource_id")
