from .scoring import sentence_stream, score_stream, write_available_now

__all__ = ["sentence_stream", "score_stream", "write_available_now"]
