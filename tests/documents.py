"""Documents of all versions that the tests read: built here, with every element that the versions have."""

import base64
import zlib

import numpy as np


def cv(accession, name, value="", unit=None):
    more = f' unitCvRef="UO" unitAccession="{unit[0]}" unitName="{unit[1]}"' if unit else ""
    return f'<cvParam cvRef="{accession.split(":")[0]}" accession="{accession}" name="{name}" value="{value}"{more}/>'


TYPES = {"<f8": ("MS:1000523", "64-bit float"), "<f4": ("MS:1000521", "32-bit float"), "<f2": ("MS:1000520", "16-bit float"), "<i2": ("MS:1000518", "16-bit integer"), "<i4": ("MS:1000519", "32-bit integer"), "<i8": ("MS:1000522", "64-bit integer")}
KINDS = {"mz": cv("MS:1000514", "m/z array", unit=("UO:0000040", "m/z")), "int": cv("MS:1000515", "intensity array"), "time": cv("MS:1000595", "time array", unit=("UO:0000010", "second")), "other": cv("MS:1000786", "non-standard data array", "charge")}


def array(kind, values, dtype="<f8", packed=False, more=""):
    raw = np.asarray(values).astype(dtype).tobytes()
    text = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
    return (
        f'<binaryDataArray encodedLength="{len(text)}">{cv(*TYPES[dtype])}{cv("MS:1000574", "zlib compression") if packed else cv("MS:1000576", "no compression")}{KINDS[kind]}{more}'
        f"<binary>{text}</binary></binaryDataArray>"
    )


def arrays(*each):
    return f'<binaryDataArrayList count="{len(each)}">{"".join(each)}</binaryDataArrayList>'


def full():
    """Version 1.1: a head with everything, four spectra, two chromatograms; accents, quotes, user parameters."""
    user = '<userParam name="note &amp; more" type="xsd:string" value="a &lt;b&gt; &quot;c&quot;"/>'
    head = f"""<cvList count="2"><cv id="MS" fullName="Mass terms" version="4.1" URI="http://example.org/ms"/><cv id="UO" fullName="Units" URI="http://example.org/uo"/></cvList>
<fileDescription><fileContent>{cv("MS:1000580", "MSn spectrum")}{user}</fileContent><sourceFileList count="1"><sourceFile id="sf1" name="a.raw" location="file:///tmp">{cv("MS:1000563", "raw file")}</sourceFile></sourceFileList>
<contact>{cv("MS:1000586", "contact name", "José Ñandú")}</contact></fileDescription>
<referenceableParamGroupList count="1"><referenceableParamGroup id="common">{cv("MS:1000130", "positive scan")}</referenceableParamGroup></referenceableParamGroupList>
<sampleList count="1"><sample id="s1" name="Sample 1">{cv("MS:1000004", "sample mass", "1.5")}</sample></sampleList>
<softwareList count="1"><software id="sw" version="1.0">{cv("MS:1000532", "maker")}</software></softwareList>
<scanSettingsList count="1"><scanSettings id="set"><sourceFileRefList count="1"><sourceFileRef ref="sf1"/></sourceFileRefList>{user}<targetList count="2"><target>{cv("MS:1000744", "selected ion m/z", "1000")}</target>
<target>{cv("MS:1000827", "target m/z", "1200.5")}{cv("MS:1000828", "lower offset", "0.5")}{cv("MS:1000829", "upper offset", "1.5")}</target></targetList></scanSettings></scanSettingsList>
<instrumentConfigurationList count="1"><instrumentConfiguration id="ic" scanSettingsRef="set"><referenceableParamGroupRef ref="common"/>{cv("MS:1000554", "instrument")}<componentList count="3"><source order="1">{cv("MS:1000073", "electrospray")}</source>
<analyzer order="2">{cv("MS:1000082", "trap")}</analyzer><detector order="3">{cv("MS:1000253", "multiplier")}</detector></componentList><softwareRef ref="sw"/></instrumentConfiguration></instrumentConfigurationList>
<dataProcessingList count="1"><dataProcessing id="dp"><processingMethod order="1" softwareRef="sw">{cv("MS:1000035", "peak picking")}{user}</processingMethod></dataProcessing></dataProcessingList>"""
    x, y = np.arange(15.0), np.arange(15.0, 0, -1)
    level = lambda n: cv("MS:1000511", "ms level", n)
    minute, second = ("UO:0000031", "minute"), ("UO:0000010", "second")
    scan = lambda t, unit: f'<scanList count="1">{cv("MS:1000795", "no combination")}<scan instrumentConfigurationRef="ic">{cv("MS:1000016", "scan start time", t, unit)}<scanWindowList count="1"><scanWindow>{cv("MS:1000501", "lower limit", "400")}{cv("MS:1000500", "upper limit", "1800")}</scanWindow></scanWindowList></scan></scanList>'
    window = f'<isolationWindow>{cv("MS:1000827", "target m/z", "445.3")}{cv("MS:1000828", "lower offset", ".5")}</isolationWindow>'
    precursor = f'<precursor spectrumRef="scan=19">{window}<selectedIonList count="2"><selectedIon>{cv("MS:1000744", "selected ion m/z", "445.34")}</selectedIon><selectedIon>{cv("MS:1000744", "selected ion m/z", "446")}{user}</selectedIon></selectedIonList><activation>{cv("MS:1000133", "collision-induced dissociation")}</activation></precursor>'
    spectra = [
        f'<spectrum index="0" id="scan=19" defaultArrayLength="15" sourceFileRef="sf1"><referenceableParamGroupRef ref="common"/>{level(1)}{cv("MS:1000504", "base peak m/z", "0")}{cv("MS:1000505", "base peak intensity", "15")}{cv("MS:1000285", "total ion current", "120")}{user}{scan("5.8905", minute)}{arrays(array("mz", x), array("int", y, "<f4", more=user))}</spectrum>',
        f'<spectrum index="1" id="scan=20" dataProcessingRef="dp" defaultArrayLength="10">{level(2)}{cv("MS:1000129", "negative scan")}'
        f'<scanList count="2">{cv("MS:1000571", "sum of spectra")}<scan>{cv("MS:1000016", "scan start time", "5.99", minute)}</scan><scan spectrumRef="scan=19">{user}</scan></scanList><precursorList count="1">{precursor}</precursorList>'
        f'<productList count="1"><product>{window}</product></productList>{arrays(array("mz", 2 * x[:10], packed=True), array("int", 2 * y[5:], packed=True), array("other", x[:10], "<i2"))}</spectrum>',
        f'<spectrum index="2" id="scan=21" defaultArrayLength="0">{level(1)}</spectrum>',
        f'<spectrum index="3" id="sample=1 cycle=22" spotID="A1,42x42" defaultArrayLength="15">{level(1)}{scan("420", second)}{arrays(array("mz", x), array("int", y))}</spectrum>',
    ]
    chroms = [
        f'<chromatogram index="0" id="tic" defaultArrayLength="15">{cv("MS:1000235", "total ion current chromatogram")}{arrays(array("time", x), array("int", y))}</chromatogram>',
        f'<chromatogram index="1" id="sic" defaultArrayLength="10" dataProcessingRef="dp">{cv("MS:1000627", "selected ion chromatogram")}{user}<precursor>{window}<activation/></precursor><product>{window}</product>{arrays(array("time", x[:10]), array("int", y[5:]))}</chromatogram>',
    ]
    run = '<run id="run 1" defaultInstrumentConfigurationRef="ic" sampleRef="s1" startTimeStamp="2007-06-27T15:23:45.00035" defaultSourceFileRef="sf1">' + cv("MS:1000857", "run attribute") + user
    return document(head, run, spectra, chroms, 'defaultDataProcessingRef="dp"')


def document(head, run, spectra, chroms=(), defaults="", version="1.1.0", charset="ISO-8859-1"):
    lists = f'<spectrumList count="{len(spectra)}" {defaults}>' + "\n".join(spectra) + "</spectrumList>"
    if chroms:
        lists += f'<chromatogramList count="{len(chroms)}" {defaults}>' + "\n".join(chroms) + "</chromatogramList>"
    return f'<?xml version="1.0" encoding="{charset}"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml" id="doc" version="{version}">\n{head}\n{run}{lists}</run></mzML>\n'


def legacy():
    """Version 0.99: legacy names of elements and attributes, lists without holders, no index of elements."""
    old = lambda accession, name, value="": f'<cvParam cvLabel="MS" accession="{accession}" name="{name}" value="{value}"/>'
    x = [0.08, 90.0]
    data = lambda accession, name, values, dtype: f'<binaryDataArray encodedLength="0">{old(*TYPES[dtype])}{old("MS:1000576", "no compression")}{old(accession, name)}<binary>{base64.b64encode(np.asarray(values).astype(dtype).tobytes()).decode()}</binary></binaryDataArray>'
    both = f'<binaryDataArrayList count="2">{data("MS:1000514", "m/z array", x, "<f8")}{data("MS:1000515", "intensity array", x, "<f4")}</binaryDataArrayList>'
    head = f"""<cvList count="1"><cv cvLabel="MS" fullName="Terms" version="2.0" URI="http://example.org/ms"/></cvList>
<fileDescription><fileContent>{old("MS:1000580", "MSn spectrum")}</fileContent><sourceFileList count="1"><sourceFile id="1" sourceFileName="old.raw" sourceFileLocation="file:///old"/></sourceFileList></fileDescription>
<referenceableParamGroupList count="1"><referenceableParamGroup id="g">{old("MS:1000130", "positive scan")}</referenceableParamGroup></referenceableParamGroupList>
<instrumentList count="1"><instrument id="LTQ"><paramGroupRef ref="g"/>{old("MS:1000554", "instrument")}<instrumentSoftwareRef ref="sw"/></instrument></instrumentList>
<softwareList count="1"><software id="sw"><softwareParam cvLabel="MS" accession="MS:1000532" name="maker" version="1.0"/></software></softwareList>
<dataProcessingList count="1"><dataProcessing id="dp" softwareRef="sw"><processingMethod order="1">{old("MS:1000033", "deisotoping", "false")}</processingMethod></dataProcessing></dataProcessingList>"""
    first = (
        f'<spectrum id="S19" scanNumber="19" msLevel="1" defaultArrayLength="2"><spectrumDescription>{old("MS:1000504", "base peak m/z", "90")}<acquisitionList count="1" methodOfCombination="sum"><acquisition number="1" spectrumRef="x">'
        f'{old("MS:1000016", "scan time", "5.5")}</acquisition></acquisitionList><scan instrumentRef="LTQ">{old("MS:1000016", "scan time", "5.5")}<selectionWindowList count="1"><selectionWindow>{old("MS:1000501", "lower", "400")}</selectionWindow></selectionWindowList></scan></spectrumDescription>{both}</spectrum>'
    )
    second = (
        f'<spectrum id="S20" scanNumber="20" msLevel="2" defaultArrayLength="2"><spectrumDescription><precursorList count="1"><precursor spectrumRef="S19"><ionSelection>{old("MS:1000040", "m/z", "445.34")}</ionSelection>'
        f'<activation>{old("MS:1000133", "dissociation")}</activation></precursor></precursorList><scan instrumentRef="LTQ"><paramGroupRef ref="g"/></scan></spectrumDescription>{both}</spectrum>'
    )
    return document(head, '<run id="old" instrumentRef="LTQ">', [first, second], version="0.99.1")
