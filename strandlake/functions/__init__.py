"""strandlake.functions"""
