"""vigilframe: text-safety, similarity and usage analytics as DataFrame transformations."""
