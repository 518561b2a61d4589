"""Schemas of the stored records; readers use them instead of inference."""

CHUNK = """id string, schema_version string, chunk_type string, text string, html string, follows_chunk string,
source struct<course_id:string,module_id:string,module_title:string,lesson_id:string,lesson_title:string,resource_type:string,section_heading:string,position_in_module:int,html_xpath:string,char_span:array<int>,item_path:string,source_references:array<struct<sourceId:string,role:string>>>,
concept_tags array<string>, learning_outcome_refs array<string>, prereq_concepts array<string>, difficulty string, bloom_level string, bloom_level_source string, content_type_label string, teaching_role string, cognitive_domain string,
tokens_estimate long, word_count long, key_terms array<struct<term:string,definition:string>>, misconceptions array<struct<misconception:string,correction:string,bloom_level:string,cognitive_domain:string>>,
targeted_concepts array<struct<concept:string,bloom_level:string>>, summary string, retrieval_text string, run_id string, created_at string"""
OUTCOMES = "learning_outcomes array<struct<id:string,statement:string,bloom_level:string,hierarchy_level:string>>, outcomes array<struct<id:string,statement:string,bloom_level:string,hierarchy_level:string>>"
MANIFEST = "slug string, title string, division string, domain string, subdomains array<string>, difficulty string, chunk_count long, total_tokens long, concept_count long"
EVENT = "event_id string, seq long, run_id string, course_id string, tool string, phase string, timestamp string, operation string, decision_type string, decision string, rationale string, alternatives_considered string, context string, confidence double, quality_level string"
OBJECTIVES = """course_code string, course_title string, terminal_objectives array<struct<id:string,statement:string,bloomLevel:string>>,
chapter_objectives array<struct<chapter:string,week_range:array<int>,objectives:array<struct<id:string,statement:string,bloomLevel:string>>>>"""
GRAPH = "nodes array<struct<id:string,label:string,frequency:long>>, edges array<struct<source:string,target:string,weight:long,relation_type:string,type:string,confidence:double>>"
_OBJ = "array<struct<objectiveId:string,statement:string,bloomLevel:string,keyConcepts:array<string>>>"
NESTED_OBJECTIVES = f"courseObjectives {_OBJ}, chapters array<struct<chapterId:string,chapterObjectives:{_OBJ},sections:array<struct<sectionId:string,sectionObjectives:{_OBJ},subsections:array<struct<subsectionId:string,subsectionObjectives:{_OBJ}>>>>>>"
