"""quillmesh: document reconciliation and training-data operators on PySpark."""
