"""Row types of the data model and the constant dimensions.

The lists below are fixed values that results depend on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POSTS = "id string, subreddit string, title string, body string, score bigint, upvote_ratio double, num_comments bigint, created_utc bigint, author string, url string, collected_at string"
COMMENTS = "id string, post_id string, subreddit string, body string, score bigint, created_utc bigint, author string"
RESULTS = "content_id string, content_type string, sentiment_label string, sentiment_score double, analyzed_at string"
CONCEPTS = "name string, definition string, category string, difficulty string, example_use_cases array<string>, related_tools array<string>, source_references array<string>"
RELATIONSHIPS = "source string, rel_type string, target string"
TRIPLES = "struct<triples:array<struct<source:string,relation:string,target:string>>>"
CHUNKS = "chunk_id string, source_file string, chunk_index int, text string"
COMMUNITIES = "community_id int, node_names array<string>, summary string, key_concepts array<string>"
DIALOGUE = "character string, dialogue string, source string"
PROFILE = "character string, personality_traits array<string>, speech_style string, iconic_lines array<string>, raw_description string, source string"
CHAT_EXAMPLE = "messages array<struct<role:string,content:string>>"

# Fixed values.
SENTIMENT_LABELS = ["Optimistic about AI", "Excited about AI capabilities", "Neutral or Informational", "Critical of AI hype", "Concerned about AI", "Fearful of AI"]
RELATIONSHIP_TYPES = ["IS_A", "PART_OF", "VARIANT_OF", "SIMILAR_TO", "USED_IN", "REQUIRES", "ALTERNATIVE_TO", "COMPLEMENTARY_TO", "BUILT_WITH", "EXTENDS"]
RELATIONSHIP_PRIORITY = ["REQUIRES", "IS_A", "PART_OF", "BUILT_WITH", "EXTENDS", "VARIANT_OF", "SIMILAR_TO", "COMPLEMENTARY_TO", "USED_IN", "ALTERNATIVE_TO"]
PREREQUISITE_TYPES = ["REQUIRES", "IS_A", "PART_OF"]
SIMILARITY_TYPES = ["SIMILAR_TO", "VARIANT_OF", "ALTERNATIVE_TO", "COMPLEMENTARY_TO"]
USAGE_TYPES = ["USED_IN", "BUILT_WITH"]
DIFFICULTIES = ["beginner", "intermediate", "advanced", "expert"]
CATEGORIES = ["Architecture", "Technique", "Model", "Tool", "Library", "Framework", "Concept", "Algorithm", "Dataset", "Evaluation", "Domain", "Infrastructure"]
CHARACTERS = ["Harvey Specter", "Bob the Builder", "Logan Roy", "Ross Geller", "Miranda Priestly", "Noddy"]
TOPIC_STOPWORDS = ["ai", "artificial", "intelligence", "machine", "learning", "model", "like", "just", "think", "know", "want", "use", "get", "one", "people", "way", "really", "thing", "make", "time", "would", "could", "also", "even", "much", "many", "well", "good", "new", "said", "going", "say", "see", "need", "come", "actually"]
QUESTION_WORDS = ["what", "is", "a", "the", "how", "does", "do", "are", "explain", "define", "tell", "me", "about", "and", "or"]
PROMPT_TEMPLATES = ["What do you think of this idea: ", "React to this: ", "Give your take on this: ", "Here's a pitch: ", "How would you respond to this: ", "What's your reaction to: ", "Thoughts on this: ", "Weigh in on this: "]


def dimension(spark: SparkSession, values: list[str], name: str = "value") -> DataFrame:
    """A constant dimension as (ord, value); small by construction, so it may be broadcast."""
    return spark.createDataFrame(list(enumerate(values)), f"ord int, {name} string")
