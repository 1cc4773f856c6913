"""Explicit schemas of the tables and JSON documents."""

TRIPLE = "struct<subject:string,predicate:string,object:string>"
TRIPLE_LIST = f"array<{TRIPLE}>"
GUIDELINE = "struct<description:string,constraints:string>"

CLASS = f"struct<name:string,description:string,usage_guideline:{GUIDELINE}>"
RELATION = "struct<subclass:string,superclass:string>"
OBJECT_PROPERTY = (
    "struct<name:string,description:string,domain:array<string>,range:array<string>,"
    f"characteristics:array<string>,usage_guideline:{GUIDELINE}>"
)
DATA_PROPERTY = (
    "struct<name:string,description:string,domain:array<string>,range:string,"
    f"characteristics:array<string>,usage_guideline:{GUIDELINE}>"
)

ONTOLOGY_JSON = (
    f"name string, classes array<{CLASS}>, subclass_relations array<{RELATION}>, "
    f"object_properties array<{OBJECT_PROPERTY}>, data_properties array<{DATA_PROPERTY}>, "
    "_corrupt_record string"
)
KG_JSON = f"name string, triplets {TRIPLE_LIST}, _corrupt_record string"

CLASSES = f"name string, description string, usage_guideline {GUIDELINE}, seq long"
SUBCLASS_OF = "subclass string, superclass string, seq long"
OBJECT_PROPERTIES = (
    "name string, description string, domain array<string>, range array<string>, "
    f"characteristics array<string>, usage_guideline {GUIDELINE}, seq long"
)
DATA_PROPERTIES = (
    "name string, description string, domain array<string>, range string, "
    f"characteristics array<string>, usage_guideline {GUIDELINE}, seq long"
)
TRIPLES = "subject string, predicate string, object string, batch_id long, seq long"
OPS = (
    "op_seq int, op string, indexes array<int>, "
    f"relations array<{RELATION}>, classes array<string>"
)

# The names an ontology document may use.
CHARACTERISTICS = [
    "functional", "inverseFunctional", "transitive", "symmetric",
    "asymmetric", "reflexive", "irreflexive",
]
DATATYPES = {
    "xsd:string": "string",
    "xsd:integer": "bigint",
    "xsd:float": "double",
    "xsd:boolean": "boolean",
    "xsd:dateTime": "timestamp",
    "xsd:date": "date",
    "xsd:time": "string",
}
