"""feedpulse.functions"""
