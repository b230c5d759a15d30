"""JSON-LD and presentation documents of records, as structs whose null fields to_json() leaves out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cataloom.functions.nested import blank_to_null


def linked_art(identifier: Column, title: Column, artist: Column, artist_qid: Column, year_min: Column, year_max: Column, medium: Column, holder: Column) -> Column:
    """A Linked Art object; production, materials and owner only where something is known of them."""
    name = F.struct(F.lit("Name").alias("type"), title.alias("content"))
    person = F.struct(F.lit("Person").alias("type"), F.concat(F.lit("http://www.wikidata.org/entity/"), artist_qid).alias("id"), blank_to_null(artist).alias("_label"))
    span = F.when(year_min.isNotNull(), F.struct(F.lit("TimeSpan").alias("type"), F.format_string("%04d-01-01", year_min).alias("begin_of_the_begin"), F.format_string("%04d-12-31", F.coalesce(year_max, year_min)).alias("end_of_the_end")))
    made = F.struct(F.lit("Production").alias("type"), F.when(blank_to_null(artist).isNotNull(), F.array(person)).alias("carried_out_by"), span.alias("timespan"))
    return F.struct(
        F.lit("https://linked.art/ns/v1/linked-art.json").alias("@context"),
        identifier.alias("id"),
        F.lit("HumanMadeObject").alias("type"),
        F.array(name).alias("identified_by"),
        F.when(blank_to_null(artist).isNotNull() | year_min.isNotNull(), made).alias("produced_by"),
        F.when(blank_to_null(medium).isNotNull(), F.array(F.struct(F.lit("Material").alias("type"), medium.alias("_label")))).alias("made_of"),
        F.when(blank_to_null(holder).isNotNull(), F.array(F.struct(F.lit("Group").alias("type"), holder.alias("_label")))).alias("current_owner"),
    )


def iiif_manifest(identifier: Column, title: Column, image: Column, width: Column, height: Column) -> Column:
    """A Presentation 3 manifest of one canvas; pixel sizes that are missing or not positive are an error."""
    sized = (width > 0) & (height > 0)
    checked = F.when(F.coalesce(sized, F.lit(False)), width).otherwise(F.raise_error(F.concat(F.lit("no pixel size: "), identifier)).cast("int"))
    canvas = F.concat(identifier, F.lit("/canvas/1"))
    body = F.struct(image.alias("id"), F.lit("Image").alias("type"), checked.alias("width"), height.alias("height"))
    note = F.struct(F.concat(canvas, F.lit("/annotation")).alias("id"), F.lit("Annotation").alias("type"), F.lit("painting").alias("motivation"), body.alias("body"), canvas.alias("target"))
    page = F.struct(F.concat(canvas, F.lit("/page")).alias("id"), F.lit("AnnotationPage").alias("type"), F.array(note).alias("items"))
    return F.struct(
        F.lit("http://iiif.io/api/presentation/3/context.json").alias("@context"),
        F.concat(identifier, F.lit("/manifest")).alias("id"),
        F.lit("Manifest").alias("type"),
        F.struct(F.array(title).alias("none")).alias("label"),
        F.array(F.struct(canvas.alias("id"), F.lit("Canvas").alias("type"), checked.alias("width"), height.alias("height"), F.array(page).alias("items"))).alias("items"),
    )
