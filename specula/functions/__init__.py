"""specula.functions"""
