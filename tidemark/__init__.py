"""tidemark: temporal memory analytics as DataFrame plans."""
