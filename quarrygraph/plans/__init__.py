"""Graph plans and the derived demonstration graph."""
