"""Settings and fixed values. Every field is used; change one with dataclasses.replace()."""

from __future__ import annotations

from dataclasses import dataclass

# Section names with the words that mark their headers; the order decides.
SECTION_KEYWORDS: list[tuple[str, list[str]]] = [
    ("education", ["education", "academic", "qualification", "university", "degree", "school", "college", "coursework"]),
    ("experience", ["experience", "employment", "work history", "professional experience", "career", "internship", "job history"]),
    ("skills", ["skills", "technical skills", "competencies", "proficiency", "technologies", "tools", "programming", "expertise"]),
    ("projects", ["projects", "portfolio", "academic projects", "personal projects", "key projects"]),
    ("certifications", ["certifications", "certificates", "licenses", "credentials", "professional development", "training"]),
    ("summary", ["summary", "objective", "profile", "about me", "introduction", "professional summary", "career objective"]),
    ("achievements", ["achievements", "awards", "honors", "accomplishments", "recognition"]),
]

# Weights of sections in weighted text.
SECTION_WEIGHTS: dict[str, float] = {
    "skills": 3.0, "experience": 2.5, "education": 1.5, "projects": 2.0,
    "certifications": 1.5, "summary": 1.0, "achievements": 1.0, "other": 0.5,
}

# Words that keyword overlap ignores.
KEYWORD_STOP_WORDS: list[str] = [
    "the", "and", "for", "are", "with", "you", "this", "that", "have", "from", "will", "can", "your", "our",
    "not", "has", "was", "all", "but", "been", "also", "they", "their", "more", "about", "which", "when", "would",
    "make", "like", "than", "other", "into", "its", "over", "such", "any", "only", "who", "what", "how", "most",
    "should", "could", "does", "did", "just", "very", "use", "using", "work", "working", "based", "well", "need",
    "must", "able", "including", "across", "ensure", "strong", "new", "best",
]

# The built-in skill vocabulary.
SKILL_VOCABULARY: list[str] = [
    # learning
    "machine learning", "deep learning", "reinforcement learning", "natural language processing", "nlp", "computer vision",
    "neural networks", "convolutional neural networks", "cnns", "recurrent neural networks", "rnns", "transformers",
    "attention mechanism", "generative ai", "gen ai", "large language models", "llm", "llms", "prompt engineering",
    "fine-tuning", "fine tuning", "retrieval augmented generation", "rag", "transfer learning", "model optimization",
    "model deployment", "feature engineering", "hyperparameter tuning", "ensemble methods", "gradient boosting", "xgboost",
    "lightgbm", "random forest", "logistic regression", "linear regression", "classification", "regression", "clustering",
    "dimensionality reduction", "anomaly detection", "fraud detection", "recommendation systems", "speech recognition",
    "text to speech", "tts", "object detection", "image classification", "semantic segmentation", "time series", "forecasting",
    # frameworks
    "pytorch", "tensorflow", "keras", "scikit-learn", "sklearn", "hugging face", "huggingface", "langchain", "llamaindex",
    "spacy", "nltk", "opencv", "fastai", "pandas", "numpy", "scipy", "matplotlib", "seaborn", "tabnet", "catboost",
    # model providers
    "openai", "gpt", "chatgpt", "gpt-4", "gpt-3", "gemini", "claude", "anthropic", "llama", "mistral", "groq", "ollama",
    # platforms
    "aws", "azure", "gcp", "google cloud", "docker", "kubernetes", "mlflow", "mlops", "ci/cd", "git", "github", "sagemaker",
    "vertex ai", "databricks",
    # data
    "sql", "nosql", "mongodb", "postgresql", "mysql", "data analysis", "data engineering", "data pipelines", "etl",
    "data visualization", "tableau", "power bi", "apache spark", "hadoop", "kafka", "airflow",
    # applications
    "python", "java", "javascript", "typescript", "c++", "rust", "go", "flask", "fastapi", "django", "react", "node.js",
    "rest api", "graphql", "microservices",
    # other
    "statistics", "probability", "linear algebra", "a/b testing", "experiment design", "agile", "scrum", "jira",
    "communication", "leadership", "teamwork",
]

# Cue words and first names of the group proxy.
GROUP_CUES: dict[str, list[str]] = {
    "male": ["he", "his", "him", "father", "son", "brother", "gentleman", "mr"],
    "female": ["she", "her", "hers", "mother", "daughter", "sister", "lady", "ms", "mrs", "miss"],
}
GROUP_NAMES: dict[str, list[str]] = {
    "male": [
        "john", "james", "robert", "michael", "william", "david", "richard", "joseph", "thomas", "charles", "daniel",
        "matthew", "anthony", "mark", "donald", "steven", "paul", "andrew", "rahul", "amit", "vikram", "arun",
        "suresh", "rajesh",
    ],
    "female": [
        "mary", "patricia", "jennifer", "linda", "elizabeth", "barbara", "susan", "jessica", "sarah", "karen",
        "nancy", "lisa", "priya", "anita", "sunita", "kavita", "neha", "pooja",
    ],
}

# Own list: English function words that TF-IDF leaves out. It is no copy of another library's list.
ENGLISH_STOP_WORDS: list[str] = [
    "a", "about", "above", "after", "again", "all", "also", "am", "an", "and", "any", "are", "as", "at", "be",
    "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "could", "did", "do",
    "does", "doing", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have", "having",
    "he", "her", "here", "hers", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "me",
    "more", "most", "my", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our",
    "out", "over", "own", "same", "she", "should", "so", "some", "such", "than", "that", "the", "their", "them",
    "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very",
    "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "would",
    "you", "your",
]


@dataclass(frozen=True)
class EngineConfig:
    tfidf_terms: int = 5000
    hybrid_semantic: float = 0.7
    hybrid_skills: float = 0.3
    threshold_percentile: float = 0.5
    per_domain: int = 110
    domain_negatives: int = 3
    semantic_k: int = 10
    skill_k: int = 5
    k_values: tuple[int, ...] = (1, 3, 5, 10)
    rerank_depth: int = 20
    rerank_batch: int = 32
    encode_batch: int = 64
    trees: int = 200
    tree_depth: int = 6
    learning_rate: float = 0.1
    test_share: float = 0.2
    seed: int = 42
    adverse_impact: float = 0.8


DEFAULT = EngineConfig()


def load_overrides(path: str, base: EngineConfig = DEFAULT) -> EngineConfig:
    """base with fields replaced from a JSON object; keys may be in any case, unknown ones are ignored."""
    import json
    from dataclasses import fields, replace

    with open(path) as f:
        given = {k.lower(): v for k, v in (json.load(f) or {}).items()}
    known = {f.name for f in fields(base)}
    return replace(base, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known})
