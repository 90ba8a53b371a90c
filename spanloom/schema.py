"""Shared schemas. Offsets are half-open and count code points."""

SPAN = "struct<start:bigint,end:bigint,label:string,text:string>"
PREDICTED = "struct<start:bigint,end:bigint,label:string,text:string,score:double>"
#: A document: its key, its text and its labelled spans in order.
DOCUMENT = f"benchmark string, doc_id string, language string, text string, gold array<{SPAN}>"
KEYS = ["benchmark", "doc_id"]
